"""Git repositories as tables, by the git program.

The repository must lie where every executor can read it.  Histories and trees are listed by one call each; contents
are read in batches on the executors, one ``git cat-file`` a batch.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import miner_path
from .tables import written


def open_repository(path: str) -> str:
    """The folder of a repository, given it or its .git."""
    at = Path(path)
    at = at.parent if at.name == ".git" else at
    if not (at / ".git").exists():
        raise FileNotFoundError(f"no repository at {path}")
    return str(at)


def git(repo: str, *args: str, stdin: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=stdin, capture_output=True, check=True).stdout


def commits(spark: SparkSession, repo: str, name: str | None = None) -> DataFrame:
    """(repo, seq, sha, parents) of what HEAD reaches, oldest first."""
    path = open_repository(repo)
    lines = git(path, "rev-list", "--topo-order", "--reverse", "--parents", "HEAD").decode().split("\n")
    rows = [(name or Path(path).name, i, x.split(" ")[0], x.split(" ")[1:]) for i, x in enumerate(filter(None, lines))]
    return spark.createDataFrame(rows, "repo string, seq long, sha string, parents array<string>")


def tree_entries(cases: DataFrame, repo: str) -> DataFrame:
    """(case_id, side, path, blob_id) of the commits (case_id, side, sha), whole trees."""
    path = open_repository(repo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for case, side, sha in zip(*(b.column(c).to_pylist() for c in ("case_id", "side", "sha"))):
                found = [x.split("\t", 1) for x in git(path, "ls-tree", "-r", "-z", sha).decode("utf-8", "replace").split("\0") if x]
                blobs = [(p, h.split(" ")[2]) for h, p in found if h.split(" ")[1] == "blob"]
                yield pa.RecordBatch.from_pydict({"case_id": pa.array([case] * len(blobs), pa.int64()), "side": [side] * len(blobs), "path": pa.array([x[0] for x in blobs], pa.string()), "blob_id": pa.array([x[1] for x in blobs], pa.string())})

    return cases.select(F.col("case_id").cast("long"), "side", "sha").mapInArrow(run, "case_id long, side string, path string, blob_id string")


def blobs(ids: DataFrame, repo: str) -> DataFrame:
    """(blob_id, content) of distinct blob ids, full or abbreviated; text is UTF-8, what isn't is replaced."""
    path = open_repository(repo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            raw, at, out = git(path, "cat-file", "--batch", stdin="\n".join(names).encode() + b"\n"), 0, []
            for _ in names:
                end = raw.index(b"\n", at)
                head = raw[at:end].split(b" ")
                if head[-1] == b"missing":
                    out.append(None)
                    at = end + 1
                    continue
                size = int(head[2])
                out.append(raw[end + 1 : end + 1 + size].decode("utf-8", "replace"))
                at = end + size + 2
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["blob_id", "content"])

    return ids.select("blob_id").where("blob_id IS NOT NULL").distinct().mapInArrow(run, "blob_id string, content string")


def files(cases: DataFrame, repo: str) -> DataFrame:
    """(case_id, side, path, content) of changed source files of cases (case_id, hashes): the first commit against the last."""
    ends = cases.select("case_id", F.explode(F.array(F.struct(F.lit("L").alias("side"), F.element_at("hashes", 1).alias("sha")), F.struct(F.lit("R").alias("side"), F.element_at("hashes", -1).alias("sha")))).alias("x")).select("case_id", "x.*")
    entries = written(tree_entries(ends, repo).where(F.col("path").endswith(".java")), "trees")
    same = entries.groupBy("case_id", "path", "blob_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    changed = entries.join(same, ["case_id", "path", "blob_id"], "left_anti")
    return changed.join(blobs(changed, repo), "blob_id").select("case_id", "side", "path", "content")


def commit_diffs(history: DataFrame, repo: str) -> DataFrame:
    """The commits with their diffs against the first parent: array of (a_path, b_path, n_hunks, valid), white space changes ignored."""
    path = open_repository(repo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for sha, parents in zip(b.column("sha").to_pylist(), b.column("parents").to_pylist()):
                rows = []
                if parents:
                    text = git(path, "diff", "-M", "-b", "--no-color", parents[0], sha).decode("utf-8", "replace")
                    for part in re.split(r"(?m)^diff --git ", text)[1:]:
                        lines = part.split("\n")
                        side = {x[:3]: x[4:].split("\t")[0] for x in lines if x.startswith(("--- ", "+++ "))}
                        moved = {x.split(" ")[1]: x.split(" ", 2)[2] for x in lines if x.startswith(("rename from ", "rename to "))}
                        a, z = side.get("---", moved.get("from")), side.get("+++", moved.get("to"))
                        name = lambda s, lead: None if s in (None, "/dev/null") else s.removeprefix(lead)
                        rows.append({"a_path": name(a, "a/"), "b_path": name(z, "b/"), "n_hunks": sum(x.startswith("@@") for x in lines)})
                out.append(rows)
            kind = pa.list_(pa.struct([("a_path", pa.string()), ("b_path", pa.string()), ("n_hunks", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("repo", "seq", "sha", "parents")), pa.array(out, kind)], ["repo", "seq", "sha", "parents", "diffs"])

    rows = history.select("repo", "seq", "sha", "parents").mapInArrow(run, "repo string, seq long, sha string, parents array<string>, diffs array<struct<a_path:string,b_path:string,n_hunks:int>>")
    judged = F.transform("diffs", lambda d: F.struct(d["a_path"].alias("a_path"), d["b_path"].alias("b_path"), d["n_hunks"].alias("n_hunks"), (miner_path(d["a_path"]) & miner_path(d["b_path"])).alias("valid")))
    return rows.withColumn("diffs", judged)
