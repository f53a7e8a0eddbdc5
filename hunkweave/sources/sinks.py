"""Text forms of results: group JSON, GraphViz, graph listings and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_json(groups: DataFrame) -> DataFrame:
    """(case_id, json): one line a case, {"groups":[[{leftPath, leftBegin, leftEnd, rightPath, rightBegin, rightEnd}]],"index":i}.

    groups: case_id, group_id, patch_id, left and right (structs path, begin, end, null where the side is missing); a
    missing side has only its path, null.
    """

    def side(s: str) -> Column:
        name = lambda k: f"{s}{k.capitalize()}"
        there = F.to_json(F.struct(*[F.col(f"{s}.{k}").alias(name(k)) for k in ("path", "begin", "end")]), {"ignoreNullFields": "false"})
        return F.when(F.col(s).isNull(), F.lit(f'{{"{s}Path":null}}')).otherwise(there)

    patch = F.concat(F.regexp_replace(side("left"), "\\}$", ","), F.regexp_replace(side("right"), "^\\{", ""))
    rows = groups.select("case_id", "group_id", "patch_id", patch.alias("j"))
    inner = rows.groupBy("case_id", "group_id").agg(F.array_sort(F.collect_list(F.struct("patch_id", "j"))).alias("x"))
    inner = inner.select("case_id", "group_id", F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["j"]), ","), F.lit("]")).alias("g"))
    outer = inner.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("group_id", "g"))).alias("x"))
    return outer.select("case_id", F.concat(F.lit('{"groups":['), F.array_join(F.transform("x", lambda r: r["g"]), ","), F.lit('],"index":'), F.col("case_id").cast("string"), F.lit("}")).alias("json"))


def dot_lines(nodes: DataFrame, edges: DataFrame, label: Column | None = None) -> DataFrame:
    """(case_id, dot): a digraph whose nodes are numbered in their order; edges carry their type."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("case_id").orderBy("patch_id")) - 1
    named = nodes.select("case_id", "patch_id", number.alias("n"), (label if label is not None else F.col("patch_id").cast("string")).alias("label"))
    lines = named.select("case_id", F.lit(0).alias("part"), F.col("n").alias("a"), F.lit(0).alias("b"), F.format_string('  %d [ label="%s" ];', "n", "label").alias("line"))
    src, dst = (named.select("case_id", F.col("patch_id").alias(c), F.col("n").alias(f"{c}_n")) for c in ("src", "dst"))
    arrows = edges.join(src, ["case_id", "src"]).join(dst, ["case_id", "dst"])
    lines = lines.union(arrows.select("case_id", F.lit(1), "src_n", "dst_n", F.format_string('  %d -> %d [ label="%s" ];', "src_n", "dst_n", "etype")))
    body = lines.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "a", "b", "line"))), lambda r: r["line"]), "\n").alias("body"))
    return body.select("case_id", F.concat(F.lit("digraph G {\n"), "body", F.lit("\n}")).alias("dot"))


def graph_text(edges: DataFrame, where: Column | None = None) -> DataFrame:
    """(case_id, src, line): "src -> [t1, t2]" with the targets in order."""
    kept = edges if where is None else edges.where(where)
    rows = kept.select("case_id", "src", "dst").distinct().groupBy("case_id", "src").agg(F.array_sort(F.collect_list("dst")).alias("x"))
    return rows.select("case_id", "src", F.concat(F.col("src").cast("string"), F.lit(" -> ["), F.array_join(F.transform("x", lambda v: v.cast("string")), ", "), F.lit("]")).alias("line"))


def timing_summary(timings: DataFrame, keys: list[str], ms: Column, failed: Column) -> DataFrame:
    """(keys, n_cases, n_failed, total_ms, average_ms): the average is over what didn't fail, in whole ms, null if all did."""
    ok = F.when(~failed, ms)
    out = timings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(failed).alias("n_failed"), F.coalesce(F.sum(ok), F.lit(0)).cast("long").alias("total_ms"))
    return out.withColumn("average_ms", F.expr("CASE WHEN n_cases > n_failed THEN total_ms DIV (n_cases - n_failed) END"))
