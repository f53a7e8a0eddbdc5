"""Tables: the driver's Parquet inputs and durable intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Folders of the intermediates that this process has written and not yet removed, and the names of those that are tables of the catalog.
_written: list[str] = []
_named: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, name: str) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows and bytes of text beyond which a table isn't sent whole to every executor.
SENT_ROWS, SENT_BYTES = 65_536, 10 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the folder that spark.checkpoint.dir names; only a local session that names none gets one.

    Spark takes a table for as large as its files.  Equal texts shrink to a hundredth there, so it would collect tables of any number of rows in the driver and send
    them to every executor; one of more than SENT_ROWS rows is joined by sorting.
    """
    path, told = _path(df.sparkSession, name), Observation()
    texts = [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema if f.dataType.typeName() == "string"]
    size = sum((F.coalesce(F.sum(c), F.lit(0)) for c in texts), F.lit(0).cast("long"))
    df.observe(told, F.count(F.lit(1)).alias("rows"), size.alias("bytes")).write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if told.get["rows"] > SENT_ROWS or told.get["bytes"] > SENT_BYTES else out


class Dealt:
    """As ``written``, dealt by columns to n buckets, where joins and groups of ``stay_dealt`` find them; rows may be added."""

    def __init__(self, df: DataFrame, name: str, n: int, by: list[str]) -> None:
        self.spark, self.n, self.by = df.sparkSession, n, by
        path = _path(self.spark, name)
        self.name = path.rsplit("/", 1)[1].replace("-", "_")
        df.repartition(n, *by).write.bucketBy(n, *by).option("path", path).saveAsTable(self.name)
        _written.append(path)
        _named.append(self.name)

    def add(self, df: DataFrame) -> None:
        df.repartition(self.n, *self.by).write.insertInto(self.name)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)


@contextmanager
def stay_dealt(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a join moves no side that is dealt by some of its keys, if the other side is dealt alike."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Tasks of a step beyond which it has larger ones, since the driver keeps figures of each, and how much larger these may be.
MANY_TASKS, LARGER = 512, 8


def tasks(n: int, rows: int) -> int:
    """How many tasks of about so many rows; of more than MANY_TASKS fewer, with up to LARGER times the rows."""
    of = lambda k: -(-n // k)
    return max(1, min(100_000, of(rows), max(MANY_TASKS, of(LARGER * rows))))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """df in tasks of about so many rows, for steps whose work its size in bytes doesn't tell.  A number that is asked for isn't coalesced."""
    return df.repartition(tasks(df.count(), rows))


def cleanup(spark: SparkSession) -> None:
    """Removes every intermediate; call it when results are written, since what reads them can't be computed again."""
    while _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")
    while _written:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
