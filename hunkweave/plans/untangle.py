"""From two snapshots of each case to groups of hunks that belong together."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import is_source_file
from ..operators import diff, graph, joins, refactorings
from ..operators.java_edges import Program
from ..sources.java import parse_files
from ..sources.tables import written

CASE = ["case_id"]
log = logging.getLogger(__name__)


def changed_files(files: DataFrame) -> DataFrame:
    """Entries (case_id, change_type, left_path, right_path, left_content, right_content) of files (case_id, side, path, content)."""
    src = files.where(is_source_file(F.col("path"))).withColumn("blob_id", F.sha1(F.col("content").cast("binary")))
    left, right = (src.where(F.col("side") == s).select("case_id", "path", "blob_id") for s in "LR")
    contents = src.select("blob_id", "content").dropDuplicates(["blob_id"])
    entries = written(diff.similar_renames(diff.tree_diff(left, right, CASE, copies=True), CASE, contents, copies=True), "entries")
    a, b = contents.toDF("left_blob", "left_content"), contents.toDF("right_blob", "right_content")
    return entries.join(a, "left_blob", "left").join(b, "right_blob", "left").select("case_id", "change_type", "left_path", "right_path", "left_content", "right_content")


def cosine(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if min(len(a), len(b)) < joins.SHINGLE:
        return 0.0
    x, y = joins.shingle_counts(a), joins.shingle_counts(b)
    dot = sum(n * y.get(s, 0) for s, n in x.items())
    return dot / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values())) if x and y else 0.0


def hunk_clones(regions: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(case_id, src, dst): hunks of the same file, src < dst, each of whose common sides is as similar as that."""
    own = F.array_join(F.transform("code", lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), " ")
    hunks = regions.groupBy("case_id", "patch_id").agg(*[F.max(F.when(F.col("side") == s, F.struct("path", own.alias("code")))).alias(n) for s, n in (("L", "left"), ("R", "right"))])
    a, b = hunks.select("case_id", F.col("patch_id").alias("src"), F.col("left").alias("al"), F.col("right").alias("ar")), hunks.select("case_id", F.col("patch_id").alias("dst"), F.col("left").alias("bl"), F.col("right").alias("br"))
    path = lambda x, y: F.coalesce(F.col(f"{x}.path"), F.col(f"{y}.path"))
    pairs = a.withColumn("p", path("ar", "al")).join(b.withColumn("p", path("br", "bl")), ["case_id", "p"]).where("src < dst")
    side = lambda x, y: F.col(x).isNull() | F.coalesce(F.col(f"{x}.path") == F.col(f"{y}.path"), F.lit(False))

    @F.pandas_udf("double")
    def similarity(x, y):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([np.nan if u is None or v is None else cosine(u, v) for u, v in zip(x, y)])

    one = lambda x, y: F.when(F.col(x).isNull(), F.lit(1.0)).otherwise(F.coalesce(F.nanvl(similarity(F.col(f"{x}.code"), F.col(f"{y}.code")), F.lit(0.0)), F.lit(0.0)))
    return pairs.where(side("al", "bl") & side("ar", "br")).where(F.least(one("al", "bl"), one("ar", "br")) >= threshold).select("case_id", "src", "dst")


def moved_code(regions: DataFrame) -> DataFrame:
    """(case_id, ref_id, patch_id): a subset of refactorings - three lines or more that one hunk deletes and another adds unchanged."""
    body = F.array_join(F.filter(F.transform("code", lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != ""), "\n")
    rows = regions.select("case_id", "side", "patch_id", body.alias("body")).where(F.size(F.split("body", "\n")) >= 3)
    both = rows.groupBy("case_id", "body").agg(F.collect_set("side").alias("s"), F.collect_set("patch_id").alias("p")).where("size(s) = 2 AND size(p) > 1")
    return both.select("case_id", F.xxhash64("body").alias("ref_id"), F.explode("p").alias("patch_id"))


def unread(nodes: DataFrame) -> DataFrame:
    """(case_id, side, path, line, kind, error): files (Failed) and members (Unread) that weren't understood."""
    return nodes.where("kind IN ('Failed', 'Unread')").select("case_id", "side", "path", F.col("b.line").alias("line"), "kind", "error")


def hunk_edges(entries: DataFrame, patches: DataFrame, regions: DataFrame, spans: DataFrame, phase: Callable[[str], None]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((case_id, src, dst, etype) without trivial ones, trivial hunks (case_id, path, patch_id), failed (case_id, error))."""
    sides = [entries.where(F.col(f"{s}_path").isNotNull()).select("case_id", F.lit(m).alias("side"), F.col(f"{s}_path").alias("path"), F.col(f"{s}_content").alias("content")) for s, m in (("left", "L"), ("right", "R"))]
    kept = regions.where("end >= begin").select("case_id", "side", "path").distinct()
    files = sides[0].union(sides[1]).dropDuplicates(["case_id", "side", "path"]).join(kept, ["case_id", "side", "path"], "left_semi")
    told = Observation("syntax")
    count = lambda kind: F.coalesce(F.count_if(F.col("kind") == kind), F.lit(0))
    nodes = written(parse_files(files).observe(told, F.count(F.lit(1)).alias("nodes"), count("Failed").alias("files"), count("Unread").alias("members")), "syntax")
    if told.get["files"] or told.get["members"]:
        log.warning("%(files)d files and %(members)d members weren't understood", told.get)
    failed = nodes.where("kind = 'Failed'").groupBy("case_id").agg(F.min(F.concat("path", F.lit(": "), "error")).alias("error"))
    program = Program(nodes)
    edges = written(program.edges(), "edges")
    where = program.nodes.select("case_id", "side", "path", F.col("key").alias("node_id"), "b", "e")
    marks = spans.select("case_id", "side", "path", "patch_id", F.col("b").alias("sb"), F.col("e").alias("se"))
    # Only nodes that an edge has can tie hunks.
    ends = edges.select("case_id", "side", F.col("src_id").alias("node_id")).union(edges.select("case_id", "side", "dst_id")).distinct()
    tied = where.join(ends, ["case_id", "side", "node_id"], "left_semi")
    cover = written(joins.span_join(tied, marks, ["case_id", "side", "path"]).select("case_id", "side", "node_id", "patch_id").distinct(), "cover")
    depend = joins.cover_lift(cover, edges.select("case_id", "src_id", "dst_id")).withColumn("etype", F.lit("DEPEND"))
    trivial = joins.trivial_hunks(regions, spans, CASE)
    sided = patches.select("case_id", "patch_id", F.coalesce("right.path", "left.path").alias("path"))
    textual = written(trivial.join(sided, ["case_id", "patch_id"]).select("case_id", "path", "patch_id"), "trivial")
    clones = hunk_clones(regions).withColumn("etype", F.lit("CLONE"))
    phase("graph")
    bodies = written(refactorings.method_bodies(program.nodes, files), "bodies")
    touched = refactorings.touched_hunks(refactorings.refactorings(bodies), bodies, regions)
    moves = written(joins.refactoring_edges(moved_code(regions).union(touched)).withColumn("etype", F.lit("REFACTOR")), "moves")
    phase("refactor")
    return graph.add_edges(depend, clones, moves), textual, failed


def untangle(files: DataFrame, phase: Callable[[str], None] = lambda name: None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups (case_id, group_id, patch_id, left, right), edges, failed) of files (case_id, side L or R, path, content).

    A case with a file that can't be read is failed and has no groups; the others aren't touched by it.  A member that can't be read is
    left out of its file's syntax only.  phase: is told as diff, graph and refactor end.
    """
    entries = written(changed_files(files), "changed")
    patches = written(diff.line_patches(entries, CASE), "patches")
    regions = written(diff.regions(patches, entries, CASE), "regions")
    spans = written(diff.token_spans(regions, CASE), "spans")
    phase("diff")
    edges, trivial, failed = hunk_edges(entries, patches, regions, spans, phase)
    edges, failed = written(edges, "edges"), written(failed, "failed")
    ok = lambda df: df.join(failed, "case_id", "left_anti")
    classes = joins.trivial_classes(trivial, ["case_id", "path"])
    groups = graph.partition_groups(ok(patches).select("case_id", "patch_id"), ok(edges), ok(classes))
    # Pairs of trivial hunks are for whoever asks for the edges; the partition reads classes.
    pairs = joins.trivial_edges(trivial, ["case_id", "path"]).select("case_id", "src", "dst", F.lit("TRIVIAL").alias("etype"))
    edges = graph.add_edges(edges, pairs)
    sides = patches.select(F.col("case_id").cast("long"), F.col("patch_id").cast("long"), "left", "right")
    return groups.join(sides, ["case_id", "patch_id"]), edges, failed


def ground_truth(steps: DataFrame) -> DataFrame:
    """Groups of a case's known steps: the hunks of step j are group j.  steps: entries with case_id and step."""
    keyed = steps.withColumn("pair", F.concat_ws(":", F.col("case_id").cast("string"), F.col("step").cast("string")))
    patches = diff.line_patches(keyed, ["case_id", "step", "pair"])
    return patches.select("case_id", F.col("step").alias("group_id"), "patch_id", "left", "right")


