"""Exact top-k inner-product search with a ball tree for each shard.

A node bounds the inner product of its vectors with a query q by q.c + |q| r, with centre c and radius r; a search
goes to the child with the higher bound first and leaves a node for the queries whose current k-th score is above
its bound.  A query is first searched in one shard; its k-th score there is the threshold with which every other
shard starts.  Queries and shards meet in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARD, BLOCK, LEAF = 4096, 4096, 96
_LEAST = np.iinfo(np.int64).min
_HITS = "query_id long, vec_id long, score long"


class BallTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.order, self.nodes = np.arange(len(ids)), []
        self.x = vectors.astype(np.float64)
        self._build(0, len(ids), leaf)
        self.ids, self.x, self.exact = ids[self.order], self.x[self.order], vectors[self.order]

    def _build(self, a: int, b: int, leaf: int) -> int:
        own = self.order[a:b]
        x = self.x[own]
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
        at = len(self.nodes)
        self.nodes.append(None)
        left = right = -1
        if b - a > leaf:
            far = x[((x - centre) ** 2).sum(axis=1).argmax()]
            other = x[((x - far) ** 2).sum(axis=1).argmax()]
            mid = (b - a) // 2
            self.order[a:b] = own[np.argpartition(x @ (other - far), mid)]
            left, right = self._build(a, a + mid, leaf), self._build(a + mid, b, leaf)
        self.nodes[at] = (a, b, centre, radius, left, right)
        return at

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of each query's best k at ``low`` or above, by falling score and rising id; none: the least long."""
        n = len(queries)
        scores, ids, kth = np.full((n, k), _LEAST), np.full((n, k), np.iinfo(np.int64).max), low.copy()
        q = queries.astype(np.float64)
        norm = np.sqrt((q**2).sum(axis=1))
        # Sums of products below 2**53 are exact in doubles.
        biggest = float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * max(1, self.x.shape[1])
        exact = biggest < 2**53

        def bound(node: int, on: np.ndarray) -> np.ndarray:
            _, _, centre, radius, _, _ = self.nodes[node]
            top = q[on] @ centre + norm[on] * radius
            return top + 1e-9 * np.abs(top) + 1e-6

        def visit(node: int, on: np.ndarray, top: np.ndarray) -> None:
            on = on[top >= kth[on]]
            if not len(on):
                return
            a, b, _, _, left, right = self.nodes[node]
            if left >= 0:
                tops = {c: bound(c, on) for c in (left, right)}
                for c in sorted(tops, key=lambda c: -tops[c].mean()):
                    visit(c, on, tops[c])
                return
            s = (q[on] @ self.x[a:b].T).astype(np.int64) if exact else queries[on] @ self.exact[a:b].T
            s[query_ids[on][:, None] == self.ids[a:b]] = _LEAST
            hit = (s >= kth[on][:, None]).any(axis=1)
            on, s = on[hit], s[hit]
            s, i = np.concatenate((scores[on], s), 1), np.concatenate((ids[on], np.broadcast_to(self.ids[a:b], s.shape)), 1)
            best = np.lexsort((i, -np.maximum(s, _LEAST + 1)), axis=1)[:, :k]
            scores[on], ids[on] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            kth[on] = np.maximum(kth[on], scores[on][:, -1])

        if len(self.ids) and n:
            everyone = np.arange(n)
            visit(0, everyone, bound(0, everyone))
        keep = scores >= np.maximum(low, _LEAST + 1)[:, None]
        scores[~keep] = _LEAST
        return scores, ids


def _rows(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = t.filter(pc.equal(t.column("dim"), dim))
    ids = t.column("id").to_numpy()
    raw = b"".join(t.column("v").to_pylist())
    return ids, np.frombuffer(raw, "<i8").reshape(len(ids), dim), t.column("low").to_numpy()


def _meet(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out, asked = [], queries.rename_columns([c.removeprefix("q_") for c in queries.column_names])
        for dim in sorted({*asked.column("dim").to_pylist()} & {*vectors.column("dim").to_pylist()}):
            ids, x, _ = _rows(vectors, dim)
            qids, q, low = _rows(asked, dim)
            scores, found = BallTree(ids, x).search(qids, q, k, low)
            at, rank = np.nonzero(scores > _LEAST)
            out.append(pa.table({"query_id": qids[at], "vec_id": found[at, rank], "score": scores[at, rank]}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})

    return run


def quantized(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v): floor(scale * x) of each component, packed as longs.

    Rows with null or non-finite parts are left out, and those with components so large that an inner product might not fit a long.
    """
    v = F.col(vector_col)
    most = F.array_max(F.transform(v, lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double"))))
    fits = F.coalesce(most * most * F.size(v) < float(1 << 62), F.size(v) == 0)
    whole = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
            parts = np.split(np.floor(scale * flat.astype(np.float64)).astype("<i8"), ends[:-1]) if len(ends) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["id", "dim", "v"])

    return vectors.where(whole).where(fits).select(F.col(id_col).cast("long"), v).mapInArrow(run, "id long, dim int, v binary")


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row whose id is divisible by ``every``.

    Candidates are all rows but those with the query's own id, with as many components as the query; ties go to
    smaller ids; a row that is repeated is a candidate as often.  Rows whose id is null, or whose vector is null, holds null or
    non-finite components or ones so large that a score might not fit a long, take no part; an empty table gives none.
    """
    rows = written(quantized(vectors, scale, id_col, vector_col), "vectors")
    n, m = rows.count(), rows.where(F.col("id") % every == 0).count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    rows = rows.withColumn("shard", F.expr(f"cast(pmod(xxhash64(id), {shards}) as int)")).withColumn("block", F.expr(f"cast(pmod(xxhash64(id, 1), {blocks}) as int)"))
    queries = rows.where(F.col("id") % every == 0).withColumn("low", F.lit(_LEAST + 1))
    cells = lambda df: df.select("shard", "block", "id", "dim", "v", "low")
    everywhere = rows.withColumn("low", F.lit(0).cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(queries: DataFrame) -> DataFrame:
        asked = cells(queries).toDF("q_shard", "q_block", "q_id", "q_dim", "q_v", "q_low")
        return cells(everywhere).groupBy("shard", "block").cogroup(asked.groupBy("q_shard", "q_block")).applyInArrow(_meet(k), _HITS)

    first = written(meet(queries), "hits")
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("kth")).where(F.col("held") >= k)
    told = queries.drop("low").join(kth, F.col("id") == F.col("query_id"), "left").withColumn("low", F.coalesce("kth", F.lit(_LEAST + 1)))
    others = told.withColumn("own", F.col("shard")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> own")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.union(meet(others)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
