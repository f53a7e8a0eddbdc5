"""Shared helpers: session settings, durable intermediate tables, words and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \x09-\x0D.  ``bytes.split()`` splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of the row group that a task holds while it writes an intermediate table.
ROW_GROUP = 16 << 20
#: Links that a task replaces by what spans them: some 50 MB.
FOREST_LINKS = 250_000
A_TO_Z, SMALL_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python and back a thousand rows at a time, unless the session says otherwise than Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session that names none, as in tests, gets one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Drops a table made by written() that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that few whole texts are held as Python objects at once."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def size_in_bytes(df: DataFrame, text_col: str) -> int:
    """The optimizer's estimate of the input, for files their size on disk; if it knows none, the bytes of the texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one made from it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, bad: DataFrame, id_col: str) -> DataFrame:
    """The rows, with all their columns, whose id (as long) isn't in the one column of ``bad``; rows with a null id stay."""
    own = fresh(df, "own_id")
    return df.join(bad.toDF(own).hint("merge"), df[id_col].cast("long") == F.col(own), "left_anti")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, A_TO_Z, SMALL_A_TO_Z)


def crc_fold(c: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(c.cast("string").cast("binary")) % 5


class Forest:
    """Component labels of the leaves of one group, with the links that joined them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Merges along the links i-j and keeps, of them, what spans the merged parts."""
        while len(i):
            li, lj = self.label[i], self.label[j]
            apart = li != lj
            i, j, li, lj = i[apart], j[apart], li[apart], lj[apart]
            if not len(i):
                return
            high, low = np.maximum(li, lj), np.minimum(li, lj)
            order = np.lexsort((low, high))
            first = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
            self.links.append((i[first], j[first]))
            to = np.arange(len(self.label))
            to[high[first]] = low[first]
            while True:  # every chain of labels goes down, so this ends
                again = to[to]
                if (again == to).all():
                    break
                to = again
            self.label = to[self.label]


def spanning(links: DataFrame) -> DataFrame:
    """(u, v), u > v: of each run of FOREST_LINKS links (u, v) that a task meets, a forest of the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def reduced() -> np.ndarray:
            nodes, at = np.unique(np.concatenate(held), return_inverse=True)
            at, forest = at.reshape(-1, 2), Forest(len(nodes))
            forest.join(at[:, 0], at[:, 1])
            return nodes[np.concatenate([np.column_stack(x) for x in forest.links])] if forest.links else np.empty((0, 2), np.int64)

        def out() -> pa.RecordBatch:
            x = reduced()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.max(axis=1)), pa.array(x.min(axis=1))], ["u", "v"])

        n = 0
        for b in batches:
            held.append(np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            n += len(b)
            if n >= FOREST_LINKS:
                held[:] = [reduced()]
                n = len(held[0])
                if n >= FOREST_LINKS // 2:  # links that share few nodes
                    yield out()
                    n = 0
        if n:
            yield out()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node of its component.

    Alternates large-star and small-star: each keeps connectivity and hangs every node from a smaller
    one, so the number of rounds grows with the logarithm of the longest path.  A star's neighbours are
    never gathered into one row; only their minimum is, which is combined before the shuffle, and the
    join back on a busy centre may be split by adaptive execution.  Of the links only forests of bounded runs are joined, so that
    a dense group counts by its nodes.
    """
    spark = links.sparkSession
    given = written(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v"), "links")
    edges = written(spanning(given.coalesce(-(-given.count() // FOREST_LINKS) or 1)).distinct(), "links")
    remove(spark, given)
    last = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        new = written(small.distinct(), "links")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, edges)
        edges = new
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
