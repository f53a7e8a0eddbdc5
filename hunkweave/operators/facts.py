"""Facts about nodes as rows: maps from a node to a value, sets of values, and their rendering.

A map fact is rows (node, value, seq), a set fact rows (node, value); what an analysis would change in place becomes a
row with a higher ``seq``, so facts are never shared between nodes by accident.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(puts: DataFrame, keys: list[str], value: str, seq: list[str]) -> DataFrame:
    """(keys, value): the last put of each key wins."""
    return puts.groupBy(*keys).agg(F.max_by(value, F.struct(*seq)).alias(value))


def assign(facts: DataFrame, pairs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(to, value): what the keys of ``pairs`` (to, keys) know; nothing where they know nothing."""
    return pairs.join(facts.select(*keys, value), keys).select("to", value)


def if_known(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys have a fact."""
    return rows.join(facts.select(*keys).distinct(), keys, "left_semi")


def merged(*sets: DataFrame) -> DataFrame:
    """The union of set facts, each value of a node once."""
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def rendered(facts: DataFrame, keys: list[str], order: list[str], text: Column, where: Column | None = None) -> DataFrame:
    """(keys, line): "[a, b]" of the facts that pass, in order."""
    kept = facts if where is None else facts.where(where)
    rows = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("line_text")))).alias("x"))
    return rows.select(*keys, F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["line_text"]), ", "), F.lit("]")).alias("line"))
