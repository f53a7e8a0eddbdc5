"""Sharding by vector bin packing: bytes, tokens and rows of the shards balanced together.

Documents of equal text are a group and stay together; only a group that is larger than a shard is split, into pieces of about
a quarter of one.  Groups of at least 1 / ``grain`` of a shard in any measure are items of their own, the smaller ones fall into
bundles by hash, so that there are at most four times ``grain`` * shards items, whatever the corpus holds.  Items are placed
from the largest, each where the weighted dot product of its loads with the residual capacities is highest.  What a row needs in order
to know its shard is then a hash and a small table: texts are read in place, and no shuffle but that of the slots moves rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, new_path, remove, written

#: Items of a kind that all shards together may have: with 64 shards or fewer, a bundle is about a thousandth of a shard.
ITEMS = 1 << 16
#: What bytes, tokens and rows count in the dot product: sizes are to be nearly equal, the others as even as that allows.
WEIGHTS = (256.0, 1.0, 1.0)
#: Rows of one shard that are numbered in one task.
NUMBERED = 1 << 18
LOADS = ["bytes", "tokens", "rows"]


def place(loads: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each item, given its loads as shares of a shard's capacity.

    Items go from the largest first load down, then by all loads and position; equal dot products go to the smaller shard.
    """
    out, left, weighted = np.zeros(len(loads), np.int32), np.ones((shards, loads.shape[1])), loads * weights
    for i in np.lexsort((np.arange(len(loads)), -loads.sum(axis=1), -loads[:, 0])):
        out[i] = at = int((left @ weighted[i]).argmax())
        left[at] -= loads[i]
    return out


def _measures(docs: DataFrame, salts: int, id_col: str, text_col: str, tokens_col: str | None) -> tuple[dict[str, Column], list[str]]:
    """Expressions of a row's group hash, salt and loads under names that docs doesn't have."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tokens = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)) if tokens_col else F.regexp_count(text, F.lit(WORD)).cast("long")
    found = {
        "group": F.xxhash64(F.col(text_col).isNull(), text),
        "salt": F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(salts)).cast("int"),
        "bytes": (F.octet_length(text) + 16).cast("long"),
        "tokens": tokens,
        "rows": F.lit(1).cast("long"),
    }
    return found, [fresh(docs, f"{c}_of_row") for c in found]


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """The documents, all columns kept, with shard (int, from 0) and slot (long, gapless from 0 in each shard).

    A row's size is the bytes of its text and 16 for its frame; a null text has none, and null texts are a group of their own.  Tokens are
    a column of docs or else the words of the text.  Rows that repeat an id and a text stay together, rows with a null id too.  Slots
    follow items, then ids (null ones first).  An empty table gives none; columns named shard or slot are replaced.
    """
    # A group's rows are dealt to salts before they are counted; pieces of a split group, and runs of a numbered one, are runs of salts.
    grain, salts = max(16, ITEMS // shards), max(256, 16 * shards)
    docs = docs.drop("shard", "slot")
    exprs, names = _measures(docs, salts, id_col, text_col, tokens_col)
    group, salt = names[:2]
    rows = docs.withColumns(dict(zip(names, exprs.values())))
    plain = rows.select(*[F.col(n).alias(c) for n, c in zip(names, exprs)])
    sums = [F.sum(c).alias(c) for c in LOADS]
    # Rows of a text and salt meet before the shuffle, so a text that a third of the rows have is a few hundred sums a map task at most.
    salted = written(plain.groupBy("group", "salt").agg(*sums), "salted")
    total = salted.agg(*sums, F.count(F.lit(1)).alias("n")).first()
    capacity = [max(1.0, (total[c] or 0) / shards) for c in LOADS]
    share = F.greatest(*[F.col(c) / F.lit(cap) for c, cap in zip(LOADS, capacity)])
    groups = salted.groupBy("group").agg(*sums).withColumn("share", share)
    large = written(groups.where(F.col("share") >= 1.0 / grain).select("group", F.when(F.col("share") > 1, F.ceil(4 * F.col("share"))).otherwise(1).cast("int").alias("pieces"), *LOADS), "large")
    # At most grain * shards groups can have so large a share of one measure, so these tables fit any task.
    split = salted.join(F.broadcast(large.where("pieces > 1").select("group", "pieces")), "group")
    piece = F.floor(F.col("salt") * F.col("pieces") / salts).cast("int")
    split = split.groupBy("group", piece.alias("piece")).agg(*sums)
    whole = large.where("pieces = 1").select("group", F.lit(0).alias("piece"), *LOADS)
    bundle = F.pmod(F.xxhash64("group"), F.lit(grain * shards))
    small = groups.where(F.col("share") < 1.0 / grain).groupBy(bundle.alias("group")).agg(*sums).select("group", F.lit(-1).alias("piece"), *LOADS)
    items = split.unionByName(whole).unionByName(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is None or not len(t):
            return
        t = t.sort_by([("piece", "ascending"), ("group", "ascending")])
        at = place(np.stack([t.column(c).to_numpy() / cap for c, cap in zip(LOADS, capacity)], 1), shards)
        start = np.zeros(len(t), np.int64)
        counts = t.column("rows").to_numpy()
        for s in range(shards):
            own = at == s
            start[own] = np.cumsum(counts[own]) - counts[own]
        yield from pa.table({"group": t.column("group"), "piece": t.column("piece"), "shard": at, "start": start, "n": counts}).combine_chunks().to_batches()

    placed = written(items.coalesce(1).mapInArrow(run, "group long, piece int, shard int, start long, n long"), "placed")

    def itemed(df: DataFrame, group: str, salt: str, key: str, which: str) -> DataFrame:
        """df with the item of each row: a bundle's number and -1, or a group's hash and its piece."""
        pieces = fresh(df, "pieces_of_group")
        df = df.join(F.broadcast(large.select(F.col("group").alias(group), F.col("pieces").alias(pieces))), group, "left")
        is_small = F.col(pieces).isNull()
        df = df.withColumn(which, F.when(is_small, -1).when(F.col(pieces) > 1, F.floor(F.col(salt) * F.col(pieces) / salts)).otherwise(0).cast("int"))
        return df.withColumn(key, F.when(is_small, F.pmod(F.xxhash64(group), F.lit(grain * shards))).otherwise(F.col(group)))

    # An item of many rows is numbered by runs of salts; where each run starts follows from the sums.
    many = placed.withColumn("runs", F.least(F.lit(salts), F.ceil(F.col("n") / NUMBERED)).cast("int"))
    run_of = F.floor(F.col("salt") * F.col("runs") / salts).cast("int")
    keyed = itemed(salted, "group", "salt", "key", "piece").drop("group").withColumnRenamed("key", "group")
    ahead = Window.partitionBy("group", "piece").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = keyed.join(F.broadcast(many.where("runs > 1")), ["group", "piece"]).groupBy("group", "piece", "start", run_of.alias("run")).agg(F.sum("rows").alias("rows"))
    runs = written(runs.withColumn("start", F.col("start") + F.coalesce(F.sum("rows").over(ahead), F.lit(0))), "runs")
    remove(docs.sparkSession, salted)

    key, which = fresh(rows, "item_of_row"), fresh(rows, "piece_of_row")
    marked = itemed(rows, group, salt, key, which)
    start, n_runs, run_ = (fresh(marked, c) for c in ("start_of_item", "runs_of_item", "run_of_row"))
    item = many.select(F.col("group").alias(key), F.col("piece").alias(which), "shard", F.col("start").alias(start), F.col("runs").alias(n_runs))
    out = marked.join(F.broadcast(item), [key, which]).withColumn(run_, F.floor(F.col(salt) * F.col(n_runs) / salts).cast("int"))
    if not runs.isEmpty():
        moved = fresh(out, "start_of_run")
        out = out.join(runs.select(F.col("group").alias(key), F.col("piece").alias(which), F.col("run").alias(run_), F.col("start").alias(moved)), [key, which, run_], "left").withColumn(start, F.coalesce(moved, start))
    place_in = Window.partitionBy(key, which, run_).orderBy(*[F.col(c).asc_nulls_first() for c in (id_col, group, names[2])])
    return out.withColumn("slot", F.col(start) + F.row_number().over(place_in).cast("long") - 1).select(*docs.columns, "shard", "slot")


def write(docs: DataFrame, shards: int = 40, **columns: str) -> DataFrame:
    """Writes each shard's documents, in the order of their slots, as Parquet in a folder of its own, and reads the whole again.

    The folder, ``written_at`` of the result, is in the shared folder and stays.
    """
    spark = docs.sparkSession
    at, out = new_path(spark, "shards"), assign(docs, shards, **columns)
    # A shard is cut into runs of slots, so that none is one task's.
    cut = F.floor(F.col("slot") / NUMBERED)
    out.repartition("shard", cut).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(at)
    back = spark.read.schema(out.schema).parquet(at)
    back.written_at = at
    return back
