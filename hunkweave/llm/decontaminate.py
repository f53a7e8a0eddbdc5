"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Windows as long as a benchmark item are taken wherever a document holds one of its five-word shingles - no other
window can be similar to it.  A window's SimHash meets the fingerprints of items of its length in a multi-index:
with more blocks than the radius, two fingerprints within the radius agree in a block.  What is within the radius
is verified by the exact weighted similarity of the shingles, their counts' minima over their maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, without, written

WIDTH, SIMILAR, RADIUS = 5, 0.8, 24
#: Up to so many distinct shingles of items go to every task; more are joined by a shuffle.
BROADCAST_SHINGLES = 500_000
_SPACES = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """Lower-cased words; null: none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SPACES), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """The hash of each five-word shingle; fewer words: of the whole sequence; none: empty."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WIDTH)]))
    return F.when(n >= WIDTH, many).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(h: str) -> list[Column]:
    return [F.sum(F.shiftright(F.col(h), b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]


def _packed(n: str) -> Column:
    bits = [F.when(F.col(f"b{b}") * 2 > F.col(n), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _blocks(fp: str, radius: int) -> Column:
    """(block, value) of each of radius + 1 runs of bits."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]))


def leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): for each document and item the most similar window at ``similar`` or more.

    start counts words from 0; ties go to the first window.  A document shorter than an item is one window.  An item
    of fewer than five words has one shingle, the whole, and is found only where it is a whole document.  Null texts
    and empty ones have no windows; rows with a null id or item take no part; documents that share an id count as one
    whose windows are those of either; repeated items are one.  Empty tables give none.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), words_of(F.col(item_text)).alias("w"))
    items = items.select("item_id", F.size("w").alias("size"), shingle_hashes(F.col("w")).alias("hs")).where("size > 0").distinct()
    items = written(items, "items")
    item_counts = items.select("item_id", "size", F.explode("hs").alias("h")).groupBy("item_id", "size", "h").agg(F.count(F.lit(1)).alias("ci"))
    marks = item_counts.select("h", "size").distinct()
    if marks.count() <= BROADCAST_SHINGLES:
        marks = F.broadcast(marks)

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    shingles = texts.select("doc_id", words_of(F.col("t")).alias("w")).select("doc_id", F.size("w").alias("n"), F.posexplode(shingle_hashes(F.col("w"))).alias("pos", "h"))
    hits = written(shingles.join(marks, "h").select("doc_id", "n", "size", "pos").distinct(), "hits")

    # Starts of windows that hold a hit, each once: those that the hit before doesn't reach.
    before = F.lag("pos").over(Window.partitionBy("doc_id", "n", "size").orderBy("pos"))
    last = F.greatest(F.col("n") - F.col("size"), F.lit(0))
    first = F.greatest(F.col("pos") - (F.col("size") - WIDTH), F.coalesce(F.col("prev") + 1, F.lit(0)), F.lit(0))
    starts = hits.withColumn("prev", before).withColumn("a", F.when(F.col("size") < WIDTH, F.col("pos")).otherwise(F.least(first, last))).withColumn("b", F.least("pos", last))
    starts = starts.where("a <= b AND (size >= 5 OR n = size)").select("doc_id", "n", "size", F.explode(F.sequence("a", "b")).alias("start")).distinct()
    spans = starts.groupBy("doc_id", "n", "size").agg(F.collect_list("start").alias("starts"))

    # The number of hits grows with the corpus, so they are never broadcast, however few.
    held = texts.join(hits.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    # Written, lest each window's slice hash its whole document again.
    held = written(held.select("doc_id", words_of(F.col("t")).alias("w")).select("doc_id", F.size("w").alias("n"), shingle_hashes(F.col("w")).alias("hs")), "held")
    own = F.greatest(F.least("size", "n") - (WIDTH - 1), F.lit(1))
    window_rows = held.join(spans, ["doc_id", "n"]).select("doc_id", "size", "n", "hs", F.explode("starts").alias("start"))
    window_rows = window_rows.select("doc_id", "size", "start", F.least("size", "n").alias("n_words"), F.slice("hs", F.col("start") + 1, own).alias("hs")).distinct()
    window_rows = written(window_rows, "windows")

    key = ["doc_id", "size", "start", "hs"]
    fps = window_rows.withColumn("m", F.size("hs")).select("m", *key, F.explode("hs").alias("h")).groupBy("m", *key).agg(*_fingerprint("h")).select(*key, _packed("m").alias("fp"))
    item_fps = items.withColumn("m", F.size("hs")).select("m", "item_id", "size", F.explode("hs").alias("h")).groupBy("m", "item_id", "size").agg(*_fingerprint("h")).select("item_id", "size", _packed("m").alias("item_fp"))
    left = fps.select(*key, "fp", _blocks("fp", radius).alias("x")).select(*key, "fp", "x.*")
    right = item_fps.select("item_id", "size", "item_fp", _blocks("item_fp", radius).alias("x")).select("item_id", "size", "item_fp", "x.*")
    near = left.join(right, ["size", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*key, "item_id").distinct()

    pair = ["doc_id", "size", "start", "item_id", "hs"]
    counted = near.select(*pair, F.explode("hs").alias("h")).groupBy(*pair, "h").agg(F.count(F.lit(1)).alias("cw"))
    shared = counted.join(item_counts, ["item_id", "size", "h"]).groupBy(*pair).agg(F.sum(F.least("cw", "ci")).alias("shared"))
    # The counts of either side add up to its number of shingles.
    total = F.size("hs") + F.greatest(F.col("size") - (WIDTH - 1), F.lit(1))
    judged = shared.withColumn("similarity", F.col("shared") / (total - F.col("shared"))).where(F.col("similarity") >= similar)
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("s"), (F.size("hs")).alias("m"), F.col("size"))).alias("x"))
    n_words = F.when(F.col("x.size") < WIDTH, F.col("x.size")).otherwise(F.col("x.m") + (WIDTH - 1))
    return best.select("doc_id", "item_id", (-F.col("x.s")).cast("long").alias("start"), n_words.cast("long").alias("n_words"), F.col("x.similarity").alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows without a leak, with all their columns; rows with a null id or text stay; rows that share an id stay or go together."""
    return without(docs, leaks(docs, benchmark, id_col=id_col, **options).select("doc_id").distinct(), id_col)
