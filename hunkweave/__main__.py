"""python -m hunkweave CONFIG --repo=NAME [--mine] [--first=false]: groups of every case of a repository, as JSON lines."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import phase_times
from .plans.untangle import changed_files, ground_truth, untangle
from .sources import cases, git, sinks, tables

#: Steps of a case are numbered within so many bits of its key.
STEP_BITS = 20


class Phases:
    """Milliseconds by phase, in the order in which the phases ended."""

    def __init__(self) -> None:
        self.began, self.took = time.time(), []

    def end(self, phase: str) -> None:
        now = time.time()
        self.took.append((phase, int(1000 * (now - self.began))))
        self.began = now

    def show(self, spark: SparkSession) -> str:
        rows = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(ms).alias("ms")) for p, ms in self.took])
        return spark.range(1).select(phase_times(rows)).first()[0]


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("config")
    args.add_argument("--repo", default="groovy")
    args.add_argument("--mine", action="store_true", help="mine the cases from the history first, where the data set lacks the repository")
    args.add_argument("--first", type=lambda x: x.lower() == "true", default=True, help="false: lines are added to those of an earlier run")
    given = args.parse_args()
    options = cases.Options.read(given.config)
    spark = SparkSession.builder.appName("hunkweave").getOrCreate()
    repo, phases = f"{options.projects}/{given.repo}", Phases()
    if given.mine:
        from .operators.sequence import mine_chains

        folder = f"{options.dataset}/mined"
        cases.write_cases(mine_chains(git.commit_diffs(git.commits(spark, repo, given.repo), repo)), folder)
        found = cases.read_cases(spark, f"{folder}/repo={given.repo}", given.repo)
        phases.end("mine")
    else:
        found = cases.read_cases(spark, f"{options.dataset}/{given.repo}.json", given.repo)
    n = found.count()
    if options.ground_truth:
        steps = found.select("case_id", F.posexplode(F.arrays_zip(F.expr("slice(hashes, 1, size(hashes) - 1)").alias("a"), F.expr("slice(hashes, 2, size(hashes) - 1)").alias("b"))).alias("step", "x"))
        pairs = steps.select((F.shiftleft("case_id", STEP_BITS) + F.col("step")).alias("case_id"), F.array("x.a", "x.b").alias("hashes"))
        entries = changed_files(git.files(pairs, repo)).withColumn("step", F.col("case_id") % (1 << STEP_BITS)).withColumn("case_id", F.shiftright("case_id", STEP_BITS))
        groups = ground_truth(entries)
    else:
        groups, _, failed = untangle(git.files(found, repo), phases.end)
        # A failed case is written with no groups.
        none = failed.select("case_id", F.concat(F.lit('{"groups":[],"index":'), F.col("case_id").cast("string"), F.lit("}")).alias("json"))
    phases.end("analyze")
    lines = sinks.group_json(groups)
    if not options.ground_truth:
        lines = lines.union(none)
    lines.select("json").write.mode("overwrite" if given.first else "append").text(f"{options.output}/{given.repo}")
    phases.end("write")
    took = sum(ms for _, ms in phases.took)
    print(f"{n} cases took {took} ms, {took // max(n, 1)} ms each: {phases.show(spark)}")
    tables.cleanup(spark)


if __name__ == "__main__":
    main()
