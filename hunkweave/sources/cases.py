"""Case lists, configuration and the lists of repositories."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Options:
    """Where things are, as a properties file says: projects.path, dataset.path, output.path, groundtruth."""

    projects: str
    dataset: str
    output: str
    ground_truth: bool = False

    @classmethod
    def read(cls, path: str) -> Options:
        pairs = (x.split("=", 1) for x in Path(path).read_text(encoding="utf-8").splitlines() if "=" in x and not x.lstrip().startswith("#"))
        held = {k.strip(): v.strip() for k, v in pairs}
        out = cls(held["projects.path"], held["dataset.path"], held["output.path"], held.get("groundtruth", "false").lower() == "true")
        for folder in (out.projects, out.dataset, out.output):
            Path(folder).mkdir(parents=True, exist_ok=True)
        return out


def read_cases(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """(repo, case_id, hashes) of a JSON file [[hash, ...], ...]; the place in it is the case."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("case_id", "hashes"))
    return rows.select(F.lit(repo).alias("repo"), F.col("case_id").cast("long").alias("case_id"), "hashes")


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    """(repo) of a text that lists them between white space."""
    return spark.read.text(path).select(F.explode(F.split("value", "\\s+")).alias("repo")).where("repo <> ''")


def write_cases(chains: DataFrame, folder: str) -> None:
    """One JSON array of hash arrays a repository, below folder/repo=NAME; repositories that are there already are left."""
    spark = chains.sparkSession
    rows = chains.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("case_id", "hashes"))).alias("x"))
    text = rows.select("repo", F.to_json(F.transform("x", lambda r: r["hashes"])).alias("value"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(at):
        there = [(s.getPath().getName().removeprefix("repo="),) for s in system.listStatus(at)]
        if there:
            text = text.join(spark.createDataFrame(there, "repo string"), "repo", "left_anti")
    text.write.partitionBy("repo").mode("append").text(folder)
