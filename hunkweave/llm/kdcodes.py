"""Compression of vectors to codes of their parts, with codebooks trained by a filtering Lloyd iteration.

Each task deals its vectors to blocks and builds a kd-tree over every part of a block, whose nodes cache count, sum and bounding
box of their points.  All entries of a codebook start at the root and go down together; a node drops those that
no point of its box can have for its nearest, and where one is left it takes the whole subtree, in training by adding the cached
sum.  What leaves a task is a sum and a count for each entry.  All arithmetic is on integers, so results don't depend on how
rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: Vectors of a block, over whose parts a tree is built, and points that a leaf of it may have.
BLOCK, LEAF = 16_384, 32


class PartTree:
    """A kd-tree over integer points in levels: node k of a level has nodes 2k and 2k + 1 below it and a run of the order."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        self.points, order, cuts = points, np.arange(n), np.array([0, n])
        self.cuts = [cuts]
        while np.diff(cuts).max(initial=0) > leaf:
            x, node = points[order], np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            low, high = np.minimum.reduceat(x, cuts[:-1]), np.maximum.reduceat(x, cuts[:-1])
            along = (high - low).argmax(axis=1)[node]
            order = order[np.lexsort((x[np.arange(n), along], node))]
            cuts = np.append(np.stack((cuts[:-1], (cuts[:-1] + cuts[1:] + 1) // 2), 1).ravel(), n)
            self.cuts.append(cuts)
        self.order, x = order, points[order]
        self.x = x
        self.nodes = []
        for cuts in self.cuts:  # bounds and sums of a level's nodes
            a = cuts[:-1]
            self.nodes.append((np.minimum.reduceat(x, a), np.maximum.reduceat(x, a), np.add.reduceat(x, a), np.diff(cuts)))

    def filter(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(nodes, entry, level) of subtrees that have one nearest entry, then (points by order, entry, -1) of those of leaves."""
        node, entry = np.zeros(len(entries), np.int64), np.arange(len(entries))
        for level, (low, high, _, _) in enumerate(self.nodes):
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            z, lo, hi = entries[entry], low[node], high[node]
            # Twice the distance from the middle of the box, in integers; ties to the lower index, which stands first.
            far = ((2 * z - lo - hi) ** 2).sum(axis=1)
            best = np.minimum.reduceat(far, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
            at_best = np.flatnonzero(far == best[group])
            pick = at_best[np.unique(group[at_best], return_index=True)[1]][group]
            own, z_best = entry[pick], entries[entry[pick]]
            # The corner that lies furthest towards z from the best entry: where z doesn't win there, it wins nowhere in the box.
            corner = np.where(z > z_best, hi, lo)
            margin = ((z - corner) ** 2).sum(axis=1) - ((z_best - corner) ** 2).sum(axis=1)
            keep = (entry == own) | (margin < 0) | ((margin == 0) & (entry < own))
            node, entry, group = node[keep], entry[keep], group[keep]
            one = np.bincount(group, minlength=len(first))[group] == 1
            if one.any():
                yield node[one], entry[one], level
            node, entry = node[~one], entry[~one]
            if not len(node):
                return
            if level + 1 < len(self.nodes):
                # Each node's entries, once for each child, children in order.
                node, entry = np.concatenate((2 * node, 2 * node + 1)), np.concatenate((entry, entry))
                order = np.lexsort((entry, node))
                node, entry = node[order], entry[order]
        cuts = self.cuts[-1]
        size = np.diff(cuts)[node]
        at = np.repeat(cuts[:-1][node] - np.cumsum(size) + size, size) + np.arange(size.sum())
        entry = np.repeat(entry, size)
        far = ((self.x[at] - entries[entry]) ** 2).sum(axis=1)
        order = np.lexsort((entry, far, at))
        at, entry = at[order], entry[order]
        first = np.append(True, at[1:] != at[:-1])
        yield at[first], entry[first], -1

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points nearest to each entry."""
        total, count = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        for which, entry, level in self.filter(entries):
            x, n = (self.x, np.ones(len(self.x), np.int64)) if level < 0 else self.nodes[level][2:]
            np.add.at(total, entry, x[which])
            np.add.at(count, entry, n[which])
        return total, count

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """The nearest entry of each point, in the order the points came in."""
        out = np.empty(len(self.points), np.int64)
        for which, entry, level in self.filter(entries):
            if level < 0:
                out[self.order[which]] = entry
            else:
                size = np.diff(self.cuts[level])[which]
                at = np.repeat(self.cuts[level][which] - np.cumsum(size) + size, size) + np.arange(size.sum())
                out[self.order[at]] = np.repeat(entry, size)
        return out


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of a task's rows with their vectors (rows, dim)."""
    held, n = [], 0

    def block() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        return t, np.frombuffer(b"".join(t.column(column).to_pylist()), "<i8").reshape(len(t), dim)

    for b in batches:
        for at in range(0, len(b), BLOCK):
            held.append(b.slice(at, BLOCK))
            n += len(held[-1])
            if n >= BLOCK:
                yield block()
                held, n = [], 0
    if n:
        yield block()


def quantized(vectors: DataFrame, scale: float, parts: int, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, label, dim, v): floor(scale * x) of each component, packed as longs.

    Rows are left out whose vector is null, holds null or non-finite components, has no components or a number of them that can't
    be cut into the parts, or holds components so large that their squared distances don't fit a long.
    """
    v = F.col(vector_col)
    most = F.array_max(F.transform(v, lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double"))))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = (F.size(v) > 0) & (F.size(v) % parts == 0) & (most * most * 4 * F.size(v) < float(1 << 62))
    rows = vectors.where(v.isNotNull()).where(whole).where(fits)
    label = F.col(label_col) if label_col else F.lit(None).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            raw = np.floor(scale * flat.astype(np.float64)).astype("<i8").tobytes()
            ends = 8 * np.cumsum(sizes, dtype=np.int64)
            packed = [raw[e - 8 * k : e] for e, k in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], ["id", "label", "dim", "v"])

    flat = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), v.alias("v"))
    return flat.mapInArrow(run, f"id long, label {flat.schema['label'].dataType.simpleString()}, dim int, v binary")


def train(rows: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, dim / parts): each starts as its part of the vectors with the smallest ids, null ones last.

    A round assigns all parts and replaces each entry by the floor of the mean of its parts; an entry that has none stays.
    """
    width = dim // parts
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    book = np.stack([np.frombuffer(r.v, "<i8").reshape(parts, width) for r in first], axis=1)

    def gathered(book: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)
            for _, x in _blocks(batches, 0, dim):
                for p in range(parts):
                    s, n = PartTree(x[:, p * width : (p + 1) * width]).sums(book[p])
                    total[p] += s
                    count[p] += n
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(total[p, e].tolist(), pa.list_(pa.int64())), pa.array(count[p, e])], ["part", "entry", "total", "n"])

        return run

    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(gathered(book), "part long, entry long, total array<long>, n long").groupBy("part", "entry").agg(*[F.sum(F.col("total")[k]).alias(f"s{k}") for k in range(width)], F.sum("n").alias("n"))
        new = book.copy()
        for r in sums.collect():  # parts * entries rows at most
            new[r.part, r.entry] = [r[f"s{k}"] // r.n for k in range(width)]
        book = new
    return book


def encode(rows: DataFrame, book: np.ndarray) -> DataFrame:
    """(id, label, code, error): the nearest entries of a vector's parts, two hex digits each, and their squared distances' sum."""
    parts, _, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, x in _blocks(batches, 2, parts * width):
            codes = np.stack([PartTree(x[:, p * width : (p + 1) * width]).codes(book[p]) for p in range(parts)], axis=1)
            near = np.concatenate([book[p][codes[:, p]] for p in range(parts)], axis=1)
            ids, labels = (t.column(k).combine_chunks() for k in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)]), pa.array(((x - near) ** 2).sum(axis=1))], ["id", "label", "code", "error"])

    return rows.select("id", "label", "v").mapInArrow(run, f"id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def decode(codes: DataFrame, book: np.ndarray, code_col: str = "code") -> DataFrame:
    """codes with ``vector``, the entries that a code names, as array<long>; null for a null code."""
    flat = F.array(*[F.array(*[F.lit(int(x)) for x in e]) for p in book for e in p])
    parts, entries, _ = book.shape
    at = lambda p: F.conv(F.substring(F.col(code_col), F.lit(1) + 2 * p, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("vector", F.when(F.col(code_col).isNotNull(), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.get(flat, p * entries + at(p))))))


def book_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, scale: float = 256.0, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row that quantized() keeps.

    Vectors of each number of components have codebooks of their own.  Ties go to the lower entry; with fewer vectors than entries there are
    fewer entries; a repeated row is coded and counted as often; rows with null ids are coded too and start codebooks last.  label_error sums
    error over rows of equal labels, null ones together.  An empty table gives no rows.  At most 256 entries, two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries: 1 to 256")
    rows = written(quantized(vectors, scale, parts, id_col, vector_col, label_col), "quantized")
    out = None
    for dim in sorted(r.dim for r in rows.select("dim").distinct().collect()):
        own = rows.where(F.col("dim") == dim)
        book = train(own, dim, parts, entries, rounds)
        coded = encode(own, book).withColumn("codebooks_sha256", F.lit(book_digest(book)))
        out = coded if out is None else out.unionByName(coded)
    if out is None:
        out = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    out = written(out, "codes")
    of = fresh(out, "of_label")
    sums = out.groupBy(F.col("label").alias(of)).agg(F.sum("error").alias("label_error"))
    return out.join(sums, F.col(of).eqNullSafe(F.col("label"))).select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
