"""Joins of hunks with ranges, clones, trivial changes, imports and ancestors."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import intervals_meet, is_comment, strip_lines


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int, a_begin: str = "begin", a_end: str = "end", b_begin: str = "b_begin", b_end: str = "b_end") -> DataFrame:
    """Pairs whose closed integer intervals overlap and whose keys are equal, each once.

    Both sides go to the buckets of ``width`` that they touch; a pair is kept in the bucket where the later of them begins, so
    no distinct is needed.  An interval with end < begin overlaps nothing.
    """
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))).alias("__bucket")
    left = a.where(F.col(a_begin) <= F.col(a_end)).select("*", bucket(a_begin, a_end))
    right = b.where(F.col(b_begin) <= F.col(b_end)).select("*", bucket(b_begin, b_end))
    meet = intervals_meet(F.col(a_begin), F.col(a_end), F.col(b_begin), F.col(b_end))
    once = F.col("__bucket") == F.floor(F.greatest(a_begin, b_begin) / width)
    return left.join(right, [*keys, "__bucket"]).where(meet & once).drop("__bucket")


def span_join(nodes: DataFrame, spans: DataFrame, keys: list[str], lines: int = 64) -> DataFrame:
    """Nodes and token spans, (line, column) structs b and e against sb and se, that overlap in lexicographic order.

    Both go to the runs of so many lines that they touch, as in overlap_join, so a long file isn't one group of pairs.
    """
    names = [c for c in [*nodes.columns, *spans.columns] if c not in ("b_line_", "e_line_")]
    own = nodes.withColumn("b_line_", F.col("b").getField("line")).withColumn("e_line_", F.col("e").getField("line"))
    other = spans.withColumn("sb_line_", F.col("sb").getField("line")).withColumn("se_line_", F.col("se").getField("line"))
    met = overlap_join(own, other, keys, lines, "b_line_", "e_line_", "sb_line_", "se_line_")
    return met.where(intervals_meet(F.col("b"), F.col("e"), F.col("sb"), F.col("se"))).select(*dict.fromkeys(names))


def inside(nodes: DataFrame, regions: DataFrame, keys: list[str], node: list[str], lines: int = 64) -> DataFrame:
    """Nodes, known by their columns ``node``, whose lines b_line..e_line touch a changed region begin..end; the rest is left out."""
    met = overlap_join(nodes, regions.select(*keys, F.col("begin").alias("r_begin"), F.col("end").alias("r_end")), keys, lines, "b_line", "e_line", "r_begin", "r_end")
    return nodes.join(met.select(*node).distinct(), node, "left_semi")


def cover_lift(cover: DataFrame, ast_edges: DataFrame) -> DataFrame:
    """Hunk edges: every hunk that covers an edge's source depends on every one that covers its target."""
    src = cover.select("case_id", F.col("node_id").alias("src_id"), F.col("patch_id").alias("src"))
    dst = cover.select("case_id", F.col("node_id").alias("dst_id"), F.col("patch_id").alias("dst"))
    return ast_edges.select("case_id", "src_id", "dst_id").distinct().join(src, ["case_id", "src_id"]).join(dst, ["case_id", "dst_id"]).where("src <> dst").select("case_id", "src", "dst").distinct()


def refactoring_edges(touched: DataFrame) -> DataFrame:
    """(case_id, src, dst) both ways between the neighbours of each refactoring's hunks: one strong component."""
    from pyspark.sql import Window

    before = F.lag("patch_id").over(Window.partitionBy("case_id", "ref_id").orderBy("patch_id"))
    pairs = touched.select("case_id", "ref_id", "patch_id").distinct().select("case_id", before.alias("src"), F.col("patch_id").alias("dst")).where("src IS NOT NULL")
    return pairs.union(pairs.select("case_id", "dst", "src")).distinct()


def same_sides(a: str, b: str) -> Column:
    """Each side that a has, b has with the same path; sides that a lacks aren't looked at."""
    side = lambda s: F.coalesce(F.col(f"{a}.{s}.path") == F.col(f"{b}.{s}.path"), F.lit(False)) | F.col(f"{a}.{s}").isNull()
    return side("left") & side("right")


def trivial_hunks(hunks: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, patch_id) of hunks each of whose sides has comments only or no changed token.

    hunks: keys, patch_id, side, code (lines); spans: keys, patch_id, side of changed tokens.
    """
    changed = spans.select(*keys, "patch_id", "side").distinct().withColumn("changed", F.lit(True))
    sides = hunks.join(changed, [*keys, "patch_id", "side"], "left")
    plain = is_comment(strip_lines(F.col("code"))) | F.col("changed").isNull()
    return sides.groupBy(*keys, "patch_id").agg(F.bool_and(plain).alias("trivial")).where("trivial").drop("trivial")


def trivial_edges(trivial: DataFrame, keys: list[str]) -> DataFrame:
    """An edge from each trivial hunk to every earlier one of the same keys.

    The result is all ordered pairs by definition; a file's hunks in one commit are few.
    """
    a, b = trivial.select(*keys, F.col("patch_id").alias("src")), trivial.select(*keys, F.col("patch_id").alias("dst"))
    return a.join(b, keys).where("src > dst")


def trivial_classes(trivial: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class_id, patch_id, n): the same edges as a class of n hunks for each keys, known by its smallest hunk; its size grows with the hunks.

    ``graph.partition_groups`` reads classes in place of their pairs.
    """
    sizes = trivial.groupBy(*keys).agg(F.min("patch_id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return trivial.join(sizes, keys).select(*keys, "class_id", "patch_id", "n")


SHINGLE = 3
_WHITE = re.compile("[ \t\n\x0b\f\r]+")


def shingle_counts(text: str) -> dict[str, int]:
    """Counts of three-character runs after white space was collapsed."""
    text = _WHITE.sub(" ", text)
    out: dict[str, int] = {}
    for i in range(len(text) - SHINGLE + 1):
        s = text[i : i + SHINGLE]
        out[s] = out.get(s, 0) + 1
    return out


def clone_classes(rows: DataFrame, keys: list[str], id_col: str, text_col: str) -> DataFrame:
    """(keys, id, class_id): rows of the same keys and the same text; class_id is the smallest id."""
    digest = F.sha2(F.col(text_col).cast("binary"), 256).alias("__digest")
    marked = rows.select(*keys, id_col, digest)
    least = marked.groupBy(*keys, "__digest").agg(F.min(id_col).alias("class_id"))
    return marked.join(least, [*keys, "__digest"]).select(*keys, id_col, "class_id")


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which text, shingle as one number, count) as shingle_counts() counts them, of all texts."""
    which, codes, counts = [], [], []
    for k, text in enumerate(texts):
        c = np.frombuffer(_WHITE.sub(" ", text).encode("utf-32-le"), np.uint32).astype(np.int64)  # a character has 21 bits
        own, n = np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)
        which.append(np.full(len(own), k, np.int32))
        codes.append(own)
        counts.append(n.astype(np.int32))
    return tuple(np.concatenate(x) if x else np.empty(0, t) for x, t in ((which, np.int32), (codes, np.int64), (counts, np.int32)))


#: Characters of the texts of a block.
BLOCK_CHARS = 8 << 20
#: Blocks that are sent as one where there are many, and how many such parts rows of the same keys have at least then: a text is sent to all of them.
TOGETHER, PARTS = 8, 4


def dealt_to_blocks(rows: DataFrame, keys: list[str], id_col: str, text_col: str, block: int = 2048) -> DataFrame:
    """(keys, id, t, ba, bb, second): the representatives of equal texts in every pair of parts that theirs is in; a part is a block or several."""
    digest = F.sha2(F.col(text_col).cast("binary"), 256)
    reps = rows.where(F.length(text_col) >= SHINGLE).groupBy(*keys, digest.alias("__digest")).agg(F.min_by(text_col, id_col).alias("t"), F.min(id_col).alias("id"), F.min(F.length(text_col)).alias("__n"))
    blocks = reps.groupBy(*keys).agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("__n") / BLOCK_CHARS)).cast("int").alias("__k"))
    k = F.col("__k")
    blocks = blocks.withColumn("__k", F.ceil(k / F.least(F.lit(TOGETHER), F.greatest(F.lit(1), F.floor(k / PARTS)))).cast("int"))
    held = reps.join(blocks, keys).withColumn("own", F.expr("cast(pmod(xxhash64(id), __k) as int)")).withColumn("o", F.explode(F.expr("sequence(0, __k - 1)")))
    return held.select(*keys, "id", "t", F.least("own", "o").alias("ba"), F.greatest("own", "o").alias("bb"), (F.col("own") > F.col("o")).alias("second"))


def _cut(rows: np.ndarray, size: np.ndarray, block: int) -> list[np.ndarray]:
    """The rows in blocks of so many at most, and of BLOCK_CHARS characters but where one row has more."""
    out, lo, chars = [], 0, 0
    for k, n in enumerate(size[rows]):
        if k > lo and (k - lo >= block or chars + n > BLOCK_CHARS):
            out.append(rows[lo:k])
            lo, chars = k, 0
        chars += n
    return [*out, rows[lo:]] if len(rows) else []


def _similar(texts: pa.ChunkedArray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of p, rows of q) whose texts are similar; of a block against itself each pair once."""
    own_block = q is p
    rows = p if own_block else np.concatenate([p, q])
    which, code, n = _shingles(texts.take(pa.array(rows)).to_pylist())
    vocabulary, word = np.unique(code, return_inverse=True)
    norms = np.bincount(which, n.astype(np.float64) ** 2, len(rows))
    side = np.arange(len(rows)) >= len(p)
    place = np.where(side, np.cumsum(side), np.cumsum(~side)) - 1
    at = [np.flatnonzero(~side), np.flatnonzero(side)]
    order = np.argsort(word, kind="stable")
    which, word, n = which[order], word[order], n[order]
    exact = np.float32 if norms.max(initial=0) < 1 << 24 else np.float64  # no sum is more than the largest norm
    dots = np.zeros((len(at[0]), len(at[0 if own_block else 1])), exact)
    for lo_word in range(0, len(vocabulary), 1024):  # a slice of the vocabulary at a time keeps the matrices small
        cut = slice(*np.searchsorted(word, [lo_word, lo_word + 1024]))
        dense = []
        for s in (False,) if own_block else (False, True):
            mine = side[which[cut]] == s
            dense.append(np.zeros((len(at[s]), 1024), exact))
            dense[-1][place[which[cut][mine]], word[cut][mine] - lo_word] = n[cut][mine]
        dots += dense[0] @ dense[-1].T
    src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    to = at[0 if own_block else 1]
    for lo in range(0, len(at[0]), 256):
        d, some = dots[lo : lo + 256].astype(np.float64), at[0][lo : lo + 256]
        i, j = np.nonzero((d > 0) & (d * d * 400 >= 289 * norms[some][:, None] * norms[to][None, :]))
        i, j = some[i], to[j]
        kept = i < j if own_block else np.ones(len(i), bool)
        src.append(rows[i[kept]])
        dst.append(rows[j[kept]])
    return np.concatenate(src), np.concatenate(dst)


def clone_pairs(rows: DataFrame, keys: list[str], id_col: str, text_col: str, block: int = 2048) -> DataFrame:
    """(keys, src, dst) of class representatives, src < dst, whose shingle cosine is 0.85 or more.

    Equal texts are one class (clone_classes), so copies make no pairs.  Texts shorter than a shingle are similar to equal
    ones only.  Rows of the same keys meet in pairs of parts of bounded size, whatever share of the rows has those keys; a text is sent as often as there are parts,
    and a part has up to TOGETHER blocks; a block pair is one product, and the test is exact in integers: dot^2 * 400 >= 289 * |a|^2 * |b|^2.
    """
    held = dealt_to_blocks(rows, keys, id_col, text_col, block)
    # A block meets itself once.
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), f"src {id_type}", f"dst {id_type}"])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        second, texts = np.array(t.column("second").to_pylist(), bool), t.column("t")
        size = np.array(pc.utf8_length(texts).to_pylist(), np.int64)
        # A part against itself, or the blocks of one part against those of the other.
        own_part = key[-2].as_py() == key[-1].as_py()
        first, other = (_cut(np.flatnonzero(s), size, block) for s in (~second, second))
        met = [(p, q) for m, p in enumerate(first) for q in (first[m:] if own_part else other)]
        found = [_similar(texts, p, q) for p, q in met]
        src, dst = ([x[s] for x in found] for s in (0, 1))
        known = t.column("id").combine_chunks()
        a, b = (known.take(pa.array(np.concatenate(x) if x else np.empty(0, np.int64))) for x in (src, dst))
        less = pc.less(a, b)
        out = [pa.repeat(key[m], len(a)).cast(t.schema.field(k).type) for m, k in enumerate(keys)]
        return pa.Table.from_arrays([*out, pc.if_else(less, a, b), pc.if_else(less, b, a)], [*keys, "src", "dst"])

    return held.groupBy(*keys, "ba", "bb").applyInArrow(run, schema)


def import_resolution(uses: DataFrame, imports: DataFrame) -> DataFrame:
    """(use_id, import_id, rule): a use meets an explicit import by its first name, a wildcard one by what stands before its last."""
    explicit = imports.where("NOT wildcard").select("file", F.col("name").alias("first"), "import_id")
    wild = imports.where("wildcard").select("file", F.col("name").alias("scope"), "import_id")
    a = uses.join(explicit, ["file", "first"]).select("use_id", "import_id", F.lit("explicit").alias("rule"))
    return a.union(uses.join(wild, ["file", "scope"]).select("use_id", "import_id", F.lit("wildcard").alias("rule")))


def first_ancestor_match(chain: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """(keys, seq, match): of the earlier rows of a chain the nearest with the same value, or null."""
    from pyspark.sql import Window

    return chain.select(*keys, seq, F.lag(seq).over(Window.partitionBy(*keys, value).orderBy(seq)).alias("match"))
