"""Operators over ordered rows: neighbours, ends and greedy chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def adjacent_same_name(rows: DataFrame, keys: list[str], name: str, order: list[str], node: str) -> DataFrame:
    """(keys, name, src, dst): each row linked to the one of the same name before it in a stable order (overloads)."""
    before = F.lag(node).over(Window.partitionBy(*keys, name).orderBy(*order))
    return rows.select(*keys, name, F.col(node).alias("src"), before.alias("dst")).where("dst IS NOT NULL")


def consecutive_pairs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, step, a, b): each row with the next one; step counts from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.select(*keys, (F.row_number().over(w) - 1).alias("step"), F.col(value).alias("a"), F.lead(value).over(w).alias("b")).where("b IS NOT NULL")


def first_last(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, first, last) by the order."""
    at = F.struct(*order, value)
    return rows.groupBy(*keys).agg(F.min(at)[value].alias("first"), F.max(at)[value].alias("last"))


def is_continuation(parents: Column, before: Column) -> Column:
    """A commit's only parent is the commit before it; a null list of parents: not."""
    return (F.size(parents) == 1) & (F.get(parents, 0) == before)


class Chain:
    """One open chain: ``start`` begins it anew with a row, ``take`` says whether the row extends it and does so."""

    def start(self, row: dict) -> None:
        raise NotImplementedError

    def take(self, row: dict) -> bool:
        raise NotImplementedError


def greedy_segments(rows: DataFrame, keys: list[str], order: list[str], carry: list[str], chain: Callable[[], Chain], schema: str) -> DataFrame:
    """(keys, order columns, segment): rows taken greedily into chains; the row that ends a chain begins the next.

    Rows are dealt by the keys and stream through in order, so a key of any length is held one row at a time.
    """

    names = [*keys, *order, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, own, segment = chain(), None, 0
        for b in batches:
            out = []
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != own:
                    own, segment = key, 0
                    open_.start(row)
                elif not open_.take(row):
                    segment += 1
                    open_.start(row)
                out.append(segment)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*keys, *order]), pa.array(out, pa.int64())], [*keys, *order, "segment"])

    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def pointer_segments(rows: DataFrame, keys: list[str], seq: str, carry: list[str], chain: Callable[[], Chain], look: int, block: int = 4096) -> DataFrame:
    """(keys, seq, segment) as greedy_segments() gives them, for keys of any length: no key is one task's.

    rows are numbered by ``seq`` without gaps in each key; a chain takes ``look`` rows at most after the one that begins it, so
    how far it goes from any row follows from the rows just after.  Rows are dealt to blocks, each with the next block's
    first rows.  What a block does is then a map from the place where the first chain begins in it to the place where the first begins in
    the next; the maps of a key are composed by doubling, which tells every block its own first place.
    """
    names = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    first = rows.groupBy(*keys).agg(F.min(seq).alias("first_"))
    own = rows.select(*keys, F.col(seq).alias("seq_"), *carry).join(first, keys).withColumn("pos_", (F.col("seq_") - F.col("first_")).cast("long"))
    own = own.withColumn("block_", F.floor(F.col("pos_") / block)).withColumn("own_", F.lit(True))
    # A row is seen by every earlier block whose last row looks as far as it: of blocks shorter than the look, by several.
    seen = F.sequence(F.greatest(F.floor((F.col("pos_") - look) / block), F.lit(0)), F.col("block_") - 1)
    ahead = own.where((F.col("pos_") % block < look) & (F.col("block_") > 0)).withColumn("block_", F.explode(seen)).where((F.col("block_") + 1) * block + look > F.col("pos_")).withColumn("own_", F.lit(False))
    dealt = own.union(ahead).drop("first_").repartition(*keys, "block_").sortWithinPartitions(*keys, "block_", "pos_")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []

        def settle(least: int) -> None:
            """Lengths from the rows that have all they look at behind them."""
            while len(held) > least:
                open_, n = chain(), 1
                open_.start(held[0])
                while n < len(held) and open_.take(held[n]):
                    n += 1
                row = held.pop(0)
                if row["own_"]:
                    out.append((*(row[k] for k in keys), row["block_"], row["pos_"], row["seq_"], n))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], columns)
            out.clear()
            return made

        columns, types = [*keys, "block_", "pos_", "seq_", "n_"], None
        for b in batches:
            types = types or [*(b.schema.field(k).type for k in keys), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            for row in b.to_pylist():
                if held and [held[-1][k] for k in (*keys, "block_")] != [row[k] for k in (*keys, "block_")]:
                    settle(0)
                held.append(row)
                settle(look)
            yield batch()
        if types:
            settle(0)
            yield batch()

    lens = dealt.withColumn("seq_", F.col("seq_").cast("long")).mapInArrow(lengths, f"{names}, block_ long, pos_ long, seq_ long, n_ long")
    runs = lens.groupBy(*keys, "block_").agg(F.array_sort(F.collect_list(F.struct("pos_", "n_", "seq_"))).alias("x"))
    runs = written(runs.select(*keys, "block_", F.transform("x", lambda r: r["n_"]).alias("lens"), F.transform("x", lambda r: r["seq_"]).alias("seqs")), "lengths")

    @F.pandas_udf("array<struct<entry:int,exit:int,n:long>>")
    def through(lens):  # noqa: ANN001, ANN202
        import pandas as pd

        def walk(x, at: int) -> dict:  # noqa: ANN001
            p, n = at, 0
            while p < len(x):
                p, n = p + int(x[p]), n + 1
            return {"entry": at, "exit": p - len(x), "n": n}

        return pd.Series([[walk(x, at) for at in range(look + 1)] for x in lens])

    # What is not full is the last block of its key, which nothing comes after.
    maps = runs.where(F.size("lens") == block).select(*keys, "block_", F.inline(through("lens")))
    most, step = runs.agg(F.max("block_")).first()[0] or 0, 1
    if most:
        maps = written(maps, "maps")
    while step <= most:
        before = maps.select(*keys, (F.col("block_") + step).alias("block_"), F.col("entry").alias("from_"), F.col("exit").alias("entry"), F.col("n").alias("m_"))
        further = before.join(maps, [*keys, "block_", "entry"]).select(*keys, "block_", F.col("from_").alias("entry"), "exit", (F.col("m_") + F.col("n")).alias("n"))
        maps, step = written(maps.where(F.col("block_") < step).unionByName(further), "maps"), 2 * step
    entry = maps.where("entry = 0").select(*keys, (F.col("block_") + 1).alias("block_"), F.col("exit").alias("at_"), F.col("n").alias("done_"))

    @F.pandas_udf("array<long>")
    def numbered(lens, at, done):  # noqa: ANN001, ANN202
        import pandas as pd

        def numbers(x, at: int, done: int) -> list[int]:  # noqa: ANN001
            out = [done - 1] * min(at, len(x))
            while len(out) < len(x):
                out += [done] * min(int(x[len(out)]), len(x) - len(out))
                done += 1
            return out

        return pd.Series([numbers(x, int(a), int(d)) for x, a, d in zip(lens, at, done)])

    placed = runs.join(entry, [*keys, "block_"], "left").withColumn("segments", numbered("lens", F.coalesce("at_", F.lit(0)), F.coalesce("done_", F.lit(0))))
    return placed.select(*keys, F.inline(F.arrays_zip("seqs", "segments"))).select(*keys, F.col("seqs").alias(seq), F.col("segments").alias("segment"))


class MinerChain(Chain):
    """The commit miner's limits: a chain has at most ``steps`` diffs, each by a commit whose only parent is the one before,
    which changes few files in few hunks each and none that an earlier commit of the chain had under its other name."""

    def __init__(self, steps: int = 5, files: int = 3, hunks: int = 5):
        self.steps, self.files, self.hunks = steps, files, hunks

    def start(self, row: dict) -> None:
        self.n, self.last, self.old, self.new = 1, row["sha"], set(), set()

    def take(self, row: dict) -> bool:
        diffs = row["diffs"] or []
        if self.n > self.steps or list(row["parents"] or ()) != [self.last] or len(diffs) > self.files:
            return False
        if any(d["n_hunks"] > self.hunks for d in diffs):
            return False
        valid = [d for d in diffs if d["valid"]]
        # An added file has no old path and a deleted one no new path; what isn't there clashes with nothing.
        old, new = ({d[k] for d in valid} - {None, ""} for k in ("a_path", "b_path"))
        if not valid or old & self.new or new & self.old or max(len(old), len(new)) > self.files:
            return False
        self.n, self.last, self.old, self.new = self.n + 1, row["sha"], self.old | old, self.new | new
        return True


def what_may_follow(commits: DataFrame) -> DataFrame:
    """The commits with parents and valid diffs only where a miner's chain may take them, as far as a commit alone tells: the others end it in any case."""
    limits = MinerChain()
    fits = (F.size("parents") == 1) & (F.size("diffs") <= limits.files) & ~F.exists("diffs", lambda d: F.coalesce(d["n_hunks"] > limits.hunks, F.lit(False))) & F.exists("diffs", lambda d: F.coalesce(d["valid"], F.lit(False)))
    return commits.select("repo", "seq", "sha", F.when(fits, F.col("parents")).alias("parents"), F.when(fits, F.filter("diffs", lambda d: d["valid"])).alias("diffs"))


def mine_chains(commits: DataFrame, block: int = 4096) -> DataFrame:
    """(repo, case_id, hashes): chains of three commits or more, short hashes, oldest first.

    commits: repo, seq (oldest first, without gaps), sha, parents, diffs (array of structs a_path, b_path, n_hunks, valid).
    """
    from ..functions.text import short_sha

    seg = pointer_segments(what_may_follow(commits), ["repo"], "seq", ["sha", "parents", "diffs"], MinerChain, 5, block)
    # A block is one short row until it is unfolded, so Spark takes all commits for few enough to be sent whole to every executor, by way of the driver.
    held = seg.hint("merge").join(commits.select("repo", "seq", "sha"), ["repo", "seq"]).groupBy("repo", "segment").agg(F.array_sort(F.collect_list(F.struct("seq", "sha"))).alias("x"))
    chains = held.where(F.size("x") > 2).select("repo", "segment", F.transform("x", lambda r: short_sha(r["sha"])).alias("hashes"))
    return chains.select("repo", (F.row_number().over(Window.partitionBy("repo").orderBy("segment")) - 1).alias("case_id"), "hashes")
