"""Refactorings between two snapshots: methods renamed or moved, extracted and inlined, found by their statements.

A method is known by its type and signature.  One that is only in the old snapshot and one that is only in the new, with most
statements in common, are one method under another name or in another place; each is taken once, the most similar first.  A new method most of whose statements
a changed method has lost was extracted from it, a lost one most of whose statements a changed method has gained was inlined into it.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .diff import best_first, similar_pairs
from .joins import overlap_join

#: Statements that a method must have to be told by them, and the share of them that must be in common.
LEAST, SHARE = 2, 0.6
METHOD = ["case_id", "owner", "sig"]


def method_bodies(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, side, path, owner, sig, begin, end, statements): the methods with bodies, statements without their white space and comments."""
    a = F.col("attrs")
    methods = nodes.where("kind = 'Method' AND attrs['body'] = 'True'").select(F.col("case_id").cast("long").alias("case_id"), "side", "path", a["owner"].alias("owner"), a["sig"].alias("sig"), F.col("b.line").alias("begin"), F.col("e.line").alias("end"))
    lines = files.select(F.col("case_id").cast("long").alias("case_id"), "side", "path", F.split("content", "\r?\n", -1).alias("lines"))
    text = F.array_join(F.slice("lines", F.col("begin"), F.col("end") - F.col("begin") + 1), "\n")
    body = F.regexp_extract(F.regexp_replace(text, "//[^\n]*|(?s:/\\*.*?\\*/)", ""), "(?s)\\{(.*)\\}", 1)
    statements = F.filter(F.transform(F.split(body, "[;{}\n]+"), lambda s: F.trim(F.regexp_replace(s, "\\s+", " "))), lambda s: s != "")
    return methods.join(lines, ["case_id", "side", "path"]).select(*METHOD, "side", "path", "begin", "end", statements.alias("statements")).dropDuplicates([*METHOD, "side"])


def _classes(rows: DataFrame) -> DataFrame:
    """(case_id, id, statements) with the class of the rows of a case whose statements are equal."""
    return rows.select("case_id", "id", "statements", F.sha2(F.array_join("statements", "\n").cast("binary"), 256).alias("class"))


def _contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(case_id, part, whole, share): parts of whose statements SHARE or more stand in a whole; of each part the fullest whole, ties to one of the same type, then to the smaller.

    Both: (case_id, id, statements).  Equal ones are a class, and classes are compared.  A part must have one of its rarest statements in common with the whole - all but as many as SHARE asks for,
    and one - so common statements make few pairs.
    """
    owner = F.substring_index("id", "#", 1)
    parts, wholes = (written(_classes(x).withColumn("owner", owner), "classed") for x in (parts, wholes))
    bag = lambda df, name: df.select("case_id", F.col("class").alias(name), "statements").dropDuplicates(["case_id", name]).select("case_id", name, F.explode("statements").alias("s")).groupBy("case_id", name, "s").agg(F.count(F.lit(1)).cast("int").alias(f"{name}_n"))
    part, whole = written(bag(parts, "part"), "statements"), written(bag(wholes, "whole"), "statements")
    often = whole.groupBy("case_id", "s").agg(F.count(F.lit(1)).alias("often"))
    items = part.join(often, ["case_id", "s"], "left").withColumn("often", F.coalesce("often", F.lit(0)))
    own = Window.partitionBy("case_id", "part")
    before = F.sum("part_n").over(own.orderBy("often", "s").rowsBetween(Window.unboundedPreceding, -1))
    prefix = items.withColumn("size", F.sum("part_n").over(own)).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= F.col("size") - F.ceil(SHARE * F.col("size")))
    pairs = prefix.select("case_id", "part", "s").join(whole, ["case_id", "s"]).select("case_id", "part", "whole").distinct()
    sizes = part.groupBy("case_id", "part").agg(F.sum("part_n").alias("size"))
    common = pairs.join(part, ["case_id", "part"]).join(whole, ["case_id", "whole", "s"]).groupBy("case_id", "part", "whole").agg(F.sum(F.least("part_n", "whole_n")).alias("common"))
    found = common.join(sizes, ["case_id", "part"]).where(F.col("common") >= SHARE * F.col("size")).withColumn("share", F.col("common") / F.col("size"))
    best = written(found.withColumn("x", F.rank().over(own.orderBy(F.desc("share")))).where("x = 1").select("case_id", F.col("part").alias("class"), F.col("whole").alias("in"), "share"), "best")
    names = wholes.select("case_id", F.col("class").alias("in"), F.col("id").alias("whole"), "owner")
    least = best.join(names.groupBy("case_id", "in").agg(F.min("whole").alias("whole")), ["case_id", "in"]).groupBy("case_id", "class").agg(F.min("whole").alias("least"), F.max("share").alias("share"))
    own_type = parts.join(best, ["case_id", "class"]).join(names, ["case_id", "in", "owner"]).groupBy("case_id", "id").agg(F.min("whole").alias("same"))
    told = parts.join(least, ["case_id", "class"]).join(own_type, ["case_id", "id"], "left")
    return told.select("case_id", F.col("id").alias("part"), F.coalesce("same", "least").alias("whole"), "share")


#: Methods and class pairs of a case that one task may match.
SMALL_CASE = 200_000


def _moved(gone: DataFrame, new: DataFrame, small: int | None = None) -> DataFrame:
    """(case_id, old, new): lost and new methods with most statements in common, each once, the most similar first; ties go by name, the old ones' first.

    Methods of equal statements are a class, and classes are compared.  Of a class always the smallest name that is left is taken, so a case's matching
    walks its class pairs in one task; a case of more than ``small`` methods and class pairs is matched by joins.
    """
    small = SMALL_CASE if small is None else small
    gone, new = (written(_classes(x), "classed") for x in (gone, new))
    none = F.lit(None).cast("string")
    blob = lambda side: F.concat(F.lit(f"{side}:"), F.col("case_id").cast("string"), F.lit(":"), "class")
    entry = lambda df, side: df.select("case_id", "class").distinct().select("case_id", *((F.lit("DELETE"), F.col("class"), none, blob(side), none) if side == "L" else (F.lit("ADD"), none, F.col("class"), none, blob(side))))
    entries = entry(gone, "L").union(entry(new, "R")).toDF("case_id", "change_type", "left_path", "right_path", "left_blob", "right_blob")
    contents = [df.select(blob(side).alias("blob_id"), F.array_join("statements", "\n").alias("content")) for df, side in ((gone, "L"), (new, "R"))]
    pairs = written(similar_pairs(entries, ["case_id"], contents[0].union(contents[1]).dropDuplicates(["blob_id"])).select("case_id", "left_path", "right_path", "score"), "similar")
    score = F.lit(None).cast("double")
    rows = pairs.select("*", F.lit("pair")).union(gone.select("case_id", "class", "id", score, F.lit("old"))).union(new.select("case_id", "class", "id", score, F.lit("new"))).toDF("case_id", "a", "b", "score", "kind")
    large = rows.groupBy("case_id").count().where(F.col("count") > small).select("case_id")
    large = written(large, "large")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        members: dict[str, dict[str, list[str]]] = {"old": {}, "new": {}}
        scores = []
        for a, b, s, kind in zip(*(t.column(c).to_pylist() for c in ("a", "b", "score", "kind"))):
            if kind == "pair":
                scores.append((-s, a, b))
            else:
                members[kind].setdefault(a, []).append(b)
        for held in members.values():
            for names in held.values():
                names.sort(reverse=True)
        heads = lambda s, a, b: (s, members["old"][a][-1], members["new"][b][-1], a, b)
        heap = [heads(*x) for x in scores]
        heapify(heap)
        out = []
        while heap:
            s, x, y, a, b = heappop(heap)
            old, new = members["old"][a], members["new"][b]
            if old and new:
                if (old[-1], new[-1]) == (x, y):
                    out.append((old.pop(), new.pop()))
                if old and new:
                    heappush(heap, heads(s, a, b))
        return pa.table({"case_id": pa.array([key[0].as_py()] * len(out), pa.int64()), "old": pa.array([x[0] for x in out], pa.string()), "new": pa.array([x[1] for x in out], pa.string())})

    found = rows.join(F.broadcast(large), "case_id", "left_anti").groupBy("case_id").applyInArrow(run, "case_id long, old string, new string")
    if large.isEmpty():
        return found
    own = pairs.join(F.broadcast(large), "case_id", "left_semi")
    whole = own.join(gone.select("case_id", F.col("class").alias("left_path"), F.col("id").alias("old")), ["case_id", "left_path"]).join(new.select("case_id", F.col("class").alias("right_path"), F.col("id").alias("new")), ["case_id", "right_path"])
    return found.union(best_first(whole.select("case_id", F.col("old").alias("left_path"), F.col("new").alias("right_path"), "score"), ["case_id"]).select("case_id", "left_path", "right_path"))


def refactorings(bodies: DataFrame) -> DataFrame:
    """(case_id, kind, old, new, ref_id): kind MOVE, EXTRACT or INLINE; old and new are the methods' names, ``owner#sig``.

    MOVE: old is new under another name, type or parameters.  EXTRACT: new came out of old, which is still there; INLINE: old went into new.
    """
    name = F.concat("owner", F.lit("#"), "sig")
    rows = written(bodies.withColumn("id", name), "bodies")
    left, right = (rows.where(F.col("side") == s) for s in "LR")
    key = ["case_id", "id"]
    told = F.size("statements") >= LEAST
    gone, new = left.join(right, key, "left_anti").where(told), right.join(left, key, "left_anti").where(told)
    moved = written(_moved(gone, new).select("case_id", F.lit("MOVE").alias("kind"), "old", "new"), "moved")
    both = left.select(*key, F.col("statements").alias("was")).join(right.select(*key, F.col("statements").alias("now")), key).where("was <> now")
    gone, new = (x.join(moved.select("case_id", F.col(c).alias("id")), key, "left_anti").select(*key, "statements") for x, c in ((gone, "old"), (new, "new")))
    lost, gained = both.select(*key, _minus("was", "now").alias("statements")), both.select(*key, _minus("now", "was").alias("statements"))
    out = _contained(new, lost).select("case_id", F.lit("EXTRACT").alias("kind"), F.col("whole").alias("old"), F.col("part").alias("new"))
    into = _contained(gone, gained).select("case_id", F.lit("INLINE").alias("kind"), F.col("part").alias("old"), F.col("whole").alias("new"))
    return moved.union(out).union(into).withColumn("ref_id", F.xxhash64("kind", "old", "new"))


def _minus(a: str, b: str):
    """The statements of a that b has fewer times, each as often as it has fewer."""
    n = lambda c, s: F.size(F.filter(c, lambda x: x == s))
    return F.flatten(F.transform(F.array_distinct(a), lambda s: F.array_repeat(s, F.greatest(n(F.col(a), s) - n(F.col(b), s), F.lit(0)))))


def touched_hunks(found: DataFrame, bodies: DataFrame, regions: DataFrame) -> DataFrame:
    """(case_id, ref_id, patch_id) of the hunks that stand in the methods of a refactoring: all that it names, before and after."""
    ends = found.select("case_id", "ref_id", F.explode(F.array("old", "new")).alias("id")).distinct()
    places = bodies.withColumn("id", F.concat("owner", F.lit("#"), "sig")).join(ends, ["case_id", "id"]).select("case_id", "side", "path", "ref_id", F.col("begin").alias("m_begin"), F.col("end").alias("m_end"))
    hunks = regions.where("end >= begin").select(F.col("case_id").cast("long").alias("case_id"), "side", "path", F.col("patch_id").cast("long").alias("patch_id"), "begin", "end")
    return overlap_join(places, hunks, ["case_id", "side", "path"], 64, "m_begin", "m_end", "begin", "end").select("case_id", "ref_id", "patch_id").distinct()
