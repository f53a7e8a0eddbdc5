"""SimHash near-dedup by a binary trie self-join.

Fingerprints are keys of a binary trie.  Two nodes of equal depth are traversed together; each level adds
the differing bit to the pair's error count and a pair is dropped once its budget is exceeded.  The budget is
spent by pigeonhole: with the bits cut into ``s`` segments, two fingerprints within ``radius`` bits differ in at
most ``radius // s`` bits of some segment, so ``s`` tries, each led by another segment, find every pair while
the first levels admit few errors.

Distribution: the first ``d`` levels are traversed by the plan itself - a fingerprint goes to every node pair of
depth ``d`` that its own node can still form - and each pair is one group.  A group returns a spanning forest of
its links, never all pairs, and skips node pairs whose leaves already hang together, so a dense group of near
copies stays cheap.  Equal fingerprints are one leaf.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Forest, components, without, written

SEED = 42


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle, repeats included; fewer words: the whole sequence; none: empty."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit word drawn from a hash; the first is the hash itself."""
    if not k:
        return h
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, n_words64: int = 1) -> bytes:
    """A bit is 1 if set in over half the hashes; big-endian.  No hash: all zero."""
    n = len(hashes)
    if not n:
        return bytes(8 * n_words64)
    out = b""
    for k in range(n_words64):
        h, ones = _mixed(hashes, k).astype(">u8").view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
        for at in range(0, n, 65_536):
            ones += np.unpackbits(h[at : at + 65_536], axis=1).sum(axis=0, dtype=np.uint32)
        out += np.packbits(ones * 2 > n).tobytes()
    return out


def fingerprints(docs: DataFrame, width: int = 4, n_words64: int = 1, id_col: str = "doc_id", text_col: str = "text", with_set: bool = False) -> DataFrame:
    """(id, fp binary) for every row; null and empty texts have the zero fingerprint.  with_set: of the distinct shingles, and 8 bytes more tell their sets apart."""

    def mark(text: bytes | None) -> bytes:
        h = shingle_hashes(text, width)
        if not with_set:
            return fingerprint(h, n_words64)
        h = np.unique(h)
        return fingerprint(h, n_words64) + xxhash.xxh64_digest(h.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [mark(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], [id_col, "fp"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"{id_col} long, fp binary")


def _expand(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node pair the positions of all its leaf pairs: (which pair, offset in a, offset in b)."""
    n = na * nb
    which = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return which, at // nb[which], at % nb[which]


def traverse(keys: np.ndarray, fps: np.ndarray, budgets: list[int], radius: int, start: int, sides: np.ndarray | None, tight: int | None = None, labels: np.ndarray | None = None, verify: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, leaf_pairs: int = 24, chunk: int = 25_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j, sure, more) that span the components of the leaves under one or two trie nodes.

    keys: uint64, the trie's bit order from the highest bit; fps: uint64 rows for the whole Hamming distance.
    budgets[t]: errors allowed in the first t+1 bits.  start: depth of the two nodes.  sides: None for a node
    with itself, else which leaves belong to the second node.  tight: up to so many bits a link is sure; of the others
    within the radius those between sure components are returned as well, for each leaf the CLOSEST ones.
    more: an end of the link has other links that are left out because of that or of what was joined.
    labels: components that hold already; then every pair within the radius that is of two components is put to ``verify``, the closest
    first, and what it confirms is joined, so that all that is returned is links which span what is confirmed.
    """
    order = np.argsort(keys, kind="stable") if sides is None else np.lexsort((keys, sides))
    k, f = keys[order], fps[order]
    n, forest = len(k), Forest(len(k))
    cut, limit = np.zeros(n, bool), 500_000
    if labels is not None:
        forest.label, tight = np.unique(labels[order], return_inverse=True)[1], -1
    na = n if sides is None else int(n - sides.sum())
    one, unsure = np.uint64(1), []
    err0 = 0 if sides is None or not start or not 0 < na < n else int(np.bitwise_count((k[0] ^ k[na]) >> np.uint64(64 - start)))
    first = (0, n, 0, n) if sides is None else (0, na, na, n)
    if first[0] >= first[1] or first[2] >= first[3]:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
    stack = [(start, np.array([first], np.int64), np.array([err0], np.int64))]

    def split(lo, hi, t):
        """Where bit t turns to 1 in the leaves lo..hi, which share the first t bits."""
        if sides is None:
            want = (k[lo] >> np.uint64(63 - t) | one) << np.uint64(63 - t)
            return np.minimum(np.maximum(np.searchsorted(k, want), lo), hi)
        out = np.empty_like(lo)
        left = lo < na
        want = (k[lo] >> np.uint64(63 - t) | one) << np.uint64(63 - t)
        out[left], out[~left] = np.searchsorted(k[:na], want[left]), na + np.searchsorted(k[na:], want[~left])
        return np.minimum(np.maximum(out, lo), hi)

    def compare(p):
        nonlocal limit
        for at in range(0, len(p), 20_000):
            q = p[at : at + 20_000]
            w, x, y = _expand(q[:, 1] - q[:, 0], q[:, 3] - q[:, 2])
            x, y = q[w, 0] + x, q[w, 2] + y
            keep = x != y if sides is not None else x < y
            x, y = x[keep], y[keep]
            for s in range(0, len(x), 4_000_000):
                xs, ys = x[s : s + 4_000_000], y[s : s + 4_000_000]
                apart = forest.label[xs] != forest.label[ys]
                xs, ys = xs[apart], ys[apart]
                apart = np.bitwise_count(f[xs] ^ f[ys]).sum(axis=1, dtype=np.int64)
                if verify is not None:
                    confirm(xs, ys, apart)
                    continue
                near = apart <= (radius if tight is None else tight)
                forest.join(xs[near], ys[near])
                if tight is not None:
                    maybe = ~near & (apart <= radius)
                    unsure.append((xs[maybe], ys[maybe], apart[maybe]))
                    if sum(len(u[0]) for u in unsure) > limit:
                        unsure[:] = [closest()]
                        limit = max(limit, 2 * len(unsure[0][0]))

    def confirm(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> None:
        near = np.flatnonzero(apart <= radius)
        near = near[np.argsort(apart[near], kind="stable")]
        for at in range(0, len(near), 2048):
            a, b = x[near[at : at + 2048]], y[near[at : at + 2048]]
            two = forest.label[a] != forest.label[b]
            a, b = a[two], b[two]
            true = verify(order[a], order[b])
            forest.join(a[true], b[true])

    def closest() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the unsure links between components the closest of each leaf."""
        x, y, apart = (np.concatenate(u) for u in zip(*unsure))
        lx, ly = forest.label[x], forest.label[y]
        x, y, apart, lx, ly = (v[lx != ly] for v in (x, y, apart, lx, ly))
        keep = np.zeros(len(x), bool)

        def first(groups: list[np.ndarray], n: int) -> None:
            at = np.lexsort((apart, *groups))
            new = np.zeros(len(at), bool)
            new[:1] = True
            for g in groups:
                new[1:] |= g[at][1:] != g[at][:-1]
            begin = np.flatnonzero(new)
            keep[at[np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at)))) < n]] = True

        first([x], CLOSEST)
        first([y], CLOSEST)
        cut[x[~keep]] = cut[y[~keep]] = True
        return x[keep], y[keep], apart[keep]

    while stack:
        t, p, err = stack.pop()
        if len(p) > chunk:
            stack.append((t, p[chunk:], err[chunk:]))
            p, err = p[:chunk], err[:chunk]
        turns = np.concatenate(([0], np.cumsum(forest.label[1:] != forest.label[:-1])))
        joined = (turns[p[:, 1] - 1] == turns[p[:, 0]]) & (turns[p[:, 3] - 1] == turns[p[:, 2]]) & (forest.label[p[:, 0]] == forest.label[p[:, 2]])
        p, err = p[~joined], err[~joined]
        small = (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2]) <= leaf_pairs
        if t >= len(budgets):
            # Leaves below the last level: in strips, so that what is joined already is skipped.
            big = p[~small]
            compare(p[small])
            strips = [(a, min(a + 512, q[1]), b, min(b + 512, q[3])) for q in big.tolist() for a in range(q[0], q[1], 512) for b in range(q[2], q[3], 512) if not (q[0] == q[2] and b < a)]
            for s in strips:
                la, lb = forest.label[s[0] : s[1]], forest.label[s[2] : s[3]]
                if la.min() != la.max() or lb.min() != lb.max() or la[0] != lb[0]:
                    compare(np.array([s], np.int64))
            continue
        compare(p[small])
        p, err = p[~small], err[~small]
        if not len(p):
            continue
        a0, a2, b0, b2 = p.T
        same = a0 == b0
        a1, b1 = split(a0, a2, t), split(b0, b2, t)
        kids = [(np.stack(x, 1), e, m) for x, e, m in (((a0, a1, b0, b1), err, True), ((a1, a2, b1, b2), err, True), ((a0, a1, b1, b2), err + 1, True), ((a1, a2, b0, b1), err + 1, ~same))]
        keeps = [(q[:, 0] < q[:, 1]) & (q[:, 2] < q[:, 3]) & (e <= budgets[t]) & m for q, e, m in kids]
        q, e = (np.concatenate([x[i][keep] for x, keep in zip(kids, keeps)]) for i in (0, 1))
        if len(q):
            stack.append((t + 1, q, e))
    i, j = (np.concatenate(x) for x in zip(*forest.links)) if forest.links else (np.empty(0, np.int64), np.empty(0, np.int64))
    sure = np.ones(len(i), bool)
    if tight is not None and labels is None:
        # Pairs inside what was joined were skipped, and a sure link may yet prove wrong.
        cut |= np.bincount(forest.label, minlength=n)[forest.label] > 2
    if unsure:
        x, y, _ = closest()
        i, j, sure = np.concatenate((i, x)), np.concatenate((j, y)), np.concatenate((sure, np.zeros(len(x), bool)))
    return order[i], order[j], sure, cut[i] | cut[j]


def _tries(bits: int, radius: int) -> list[tuple[int, list[int]]]:
    """(rotation, budgets) of each trie: as many segments as keep a budget of at most one error in each."""
    s = max(1, math.ceil((radius + 1) / 2))
    cuts = [round(i * bits / s) for i in range(s + 1)]
    return [(a, [radius // s] * (b - a) + [radius] * (bits - (b - a))) for a, b in zip(cuts, cuts[1:])]


def _neighbours(prefix: Column, d: int, budget: int) -> Column:
    """Every prefix of d bits that differs in at most ``budget`` bits, itself first."""
    flips = [0] + [sum(1 << b for b in c) for e in range(1, budget + 1) for c in combinations(range(d), e)]
    return F.array(*[prefix.bitwiseXOR(F.lit(x)) for x in flips])


def links(fps: DataFrame, radius: int = 4, leaves: int = 16_384) -> DataFrame:
    """Links (a, b) of distinct 64-bit fingerprints ``fp`` (long) that span the components within ``radius`` bits.

    leaves: about how many fingerprints a node of the first group level holds; it sets that level's depth from
    their number, so groups keep their size as the input grows.  Nodes that hold far more are cut into blocks,
    each pair of blocks a group of its own.
    """
    spark = fps.sparkSession
    n = fps.count()
    d = max(3, min(20, math.ceil(math.log2(max(1, n) / leaves))))
    tries = _tries(64, radius)
    rotated = F.explode(F.array(*[F.struct(F.lit(i).alias("trie"), (F.expr(f"(fp << {a}) | shiftrightunsigned(fp, {64 - a})") if a else F.col("fp")).alias("key")) for i, (a, _) in enumerate(tries)])).alias("x")
    rows = fps.select("fp", rotated).select("fp", "x.trie", "x.key", F.expr(f"cast(shiftrightunsigned(x.key, {64 - d}) as int)").alias("p"))
    held = rows.groupBy("trie", "p").count().where(F.col("count") > 8 * leaves)
    blocks = {(r.trie, r.p): math.ceil(r["count"] / (4 * leaves)) for r in held.collect()}  # at most n * tries / (8 * leaves) rows
    budget = max(b[d - 1] for _, b in tries)
    pair = rows.select("fp", "trie", "key", "p", F.explode(_neighbours(F.col("p"), d, budget)).alias("q"))
    pair = pair.select("fp", "trie", "key", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), (F.col("p") > F.col("q")).alias("second"))
    if blocks:
        pieces = spark.createDataFrame([(*k, v) for k, v in blocks.items()], "trie int, p int, k int")
        own, other = pieces.select("trie", F.col("p").alias("mine"), F.col("k").alias("k1")), pieces.select("trie", F.col("p").alias("theirs"), F.col("k").alias("k2"))
        pair = pair.withColumn("mine", F.expr("if(second, hi, lo)")).withColumn("theirs", F.expr("if(second, lo, hi)"))
        pair = pair.join(F.broadcast(own), ["trie", "mine"], "left").join(F.broadcast(other), ["trie", "theirs"], "left").na.fill(1, ["k1", "k2"])
        pair = pair.withColumn("own", F.expr("cast(pmod(xxhash64(fp), k1) as int)")).withColumn("o", F.explode(F.expr("sequence(0, k2 - 1)")))
        same = F.col("lo") == F.col("hi")
        pair = pair.select("fp", "trie", "key", "lo", "hi", F.when(same, F.col("own") > F.col("o")).otherwise(F.col("second")).alias("second"), F.when(same, F.least("own", "o")).when(F.col("second"), F.col("o")).otherwise(F.col("own")).alias("ba"), F.when(same, F.greatest("own", "o")).when(F.col("second"), F.col("own")).otherwise(F.col("o")).alias("bb"))
    else:
        pair = pair.withColumn("ba", F.lit(0)).withColumn("bb", F.lit(0))
    keys = ["trie", "lo", "hi", "ba", "bb"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        trie, lo, hi, ba, bb = (x.as_py() for x in key)
        fp, order = t.column("fp").to_numpy(), t.column("key").to_numpy().view(np.uint64)
        same = (lo, ba) == (hi, bb)
        i, j, *_ = traverse(order, fp.view(np.uint64).reshape(-1, 1), tries[trie][1], radius, d, None if same else t.column("second").to_numpy().astype(np.int64))
        return pa.table({"a": fp[i], "b": fp[j]})

    return pair.select("fp", "key", "second", *keys).groupBy(*keys).applyInArrow(run, "a long, b long").distinct()


def near_dedup(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): documents whose fingerprints link at ``radius`` or fewer differing bits.

    component_id is the smallest id reachable.  Null and empty texts have fingerprint zero and link like any
    other; a null id never becomes a component_id unless nothing else is reachable; repeated rows stay repeated;
    an empty table gives an empty result; columns beside id and text are ignored.
    """
    marks = written(fingerprints(docs, width, 1, id_col, text_col).select(id_col, F.conv(F.hex("fp"), 16, -10).cast("long").alias("fp")), "fingerprints")
    leaves = marks.groupBy("fp").agg(F.min(id_col).alias("low"))
    leaves = written(leaves, "leaves")
    roots = components(links(leaves.select("fp"), radius))
    # The smallest id of a component is the least of its fingerprints' smallest ids.
    held = leaves.join(roots, leaves.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = held.groupBy("root").agg(F.min("low").alias("component_id"))
    named = held.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For five-word shingles and a similarity of 0.8: fingerprints of WORDS64 * 64 bits, of which a shingle set's differ in about
#: 15 % at that similarity.  Each of 20 tries leads with 24 of the bits and admits two errors in them, which finds
#: such a pair with a probability of over 0.99 together.  Pairs of at most TIGHT bits are almost surely similar, so of them a
#: spanning forest is enough; of those up to LOOSE bits each leaf's closest in every other tree.  All are verified by
#: their shingles.
WORDS64, TRIE_BITS, TRIE_ERRORS, TIGHT, LOOSE = 4, 24, 2, 24, 58


#: Of the links that are not sure a search returns so many of each leaf, the closest; what it leaves out is searched for again
#: once these are verified.
CLOSEST = 6


def _led_keys(fps: np.ndarray) -> list[np.ndarray]:
    """The leading bits of each trie: runs of the fingerprint's bits in two orders."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
    out = []
    for order in (np.arange(bits.shape[1]), np.random.default_rng(SEED).permutation(bits.shape[1])):
        for a in range(0, bits.shape[1] - TRIE_BITS + 1, TRIE_BITS):
            key = np.zeros((len(fps), 64), np.uint8)
            key[:, :TRIE_BITS] = bits[:, order[a : a + TRIE_BITS]]
            out.append(np.packbits(key, axis=1).view(">u8").ravel().astype(np.uint64))
    return out


def _unpacked(fps: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The fingerprints' words, without what tells equal ones apart."""
    chunks = fps.chunks if isinstance(fps, pa.ChunkedArray) else [fps]
    parts = [np.frombuffer(b"".join(c.slice(at, 8192).to_pylist()), ">u8").reshape(min(8192, len(c) - at), -1)[:, :WORDS64].astype(np.uint64) for c in chunks for at in range(0, len(c), 8192)]
    return np.concatenate(parts) if parts else np.empty((0, WORDS64), np.uint64)


def _blocks(leaves: DataFrame, d: int, per_node: int) -> np.ndarray:
    """Into how many blocks each node of depth d of each trie is cut: more than one where it holds over twice per_node leaves."""
    tries = 2 * (64 * WORDS64 // TRIE_BITS)
    out = np.ones((tries, 1 << d), np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((tries, 1 << d), np.int64)
        for b in batches:
            for trie, key in enumerate(_led_keys(_unpacked(b.column(0)))):
                n[trie] += np.bincount((key >> np.uint64(64 - d)).astype(np.int64), minlength=1 << d) if d else len(key)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], ["node", "n"])

    heavy = leaves.select("fp").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * per_node)
    for r in heavy.collect():  # at most as many rows as nodes, of which there are leaves / per_node in each trie
        out.ravel()[r.node] = math.ceil(r.n / per_node)
    return out


def similar_sets(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similar: float) -> np.ndarray:
    """Whether the sets i and j, sorted and without repeats, have that Jaccard similarity; two empty ones have."""
    sizes = np.array([len(x) for x in sets], np.int64)
    out = np.minimum(sizes[i], sizes[j]) >= similar * np.maximum(sizes[i], sizes[j])
    todo = np.flatnonzero(out & (sizes[i] > 0))
    todo = todo[np.argsort(i[todo], kind="stable")]
    for own in np.split(todo, np.flatnonzero(np.diff(i[todo])) + 1) if len(todo) else []:
        x, others = sets[i[own[0]]], j[own]
        flat, n = np.concatenate([sets[k] for k in others]), sizes[others]
        hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
        both = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
        out[own] = both >= similar * (len(x) + n - both)
    return out


def candidate_links(leaves: DataFrame, per_node: int = 200_000, similar: float | None = None) -> DataFrame:
    """(a, b, sure, apart, more) between the ids ``low`` of distinct fingerprints ``fp`` (binary), by the tries of _led_keys().

    With columns ``label``, ``main`` and ``s`` (shingle sets), links of two labels that are verified to be ``similar`` where their leaves meet, so that only
    what spans them leaves a group; none between two main leaves.  A pair that several tries propose is verified in the first.  A group is a pair of nodes, or of blocks of these where a node holds far more than ``per_node`` leaves.
    """
    n = leaves.count()
    d = max(0, min(16, math.ceil(math.log2(max(1, n) / per_node))))
    masks = [0] + [sum(1 << b for b in c) for e in range(1, TRIE_ERRORS + 1) for c in combinations(range(d), e)]
    known = ["label", "main", "s"] if similar is not None else []
    cuts = _blocks(leaves, d, per_node)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = b.column(0).to_numpy()
            mixed = _mixed(low.view(np.uint64), 1)
            for trie, key in enumerate(_led_keys(_unpacked(b.column(1)))):
                p = (key >> np.uint64(64 - d)).astype(np.int64) if d else np.zeros(len(low), np.int64)
                own = (mixed % cuts[trie, p].astype(np.uint64)).astype(np.int64)
                for m in masks:
                    q = p ^ m
                    for o in range(int(cuts[trie, q].max(initial=0))):
                        # Of a node with itself each pair of blocks is one group; of two nodes the lower has the first block.
                        second = own > o if not m else p > q
                        at = pa.array(o < cuts[trie, q])
                        rows = [pa.array(np.full(len(low), trie), pa.int32()), pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(np.where(second, o, own)), pa.array(np.where(second, own, o)), pa.array(second), pa.array(key.view(np.int64)), *b.columns]
                        yield pa.RecordBatch.from_arrays(rows, [*keys, "second", "key", "low", "fp", *known]).filter(at)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        trie, lo, hi, ba, bb = (x.as_py() for x in key)
        ids, fps = t.column("low").to_numpy(), _unpacked(t.column("fp"))
        order, second = t.column("key").to_numpy().view(np.uint64), None if (lo, ba) == (hi, bb) else t.column("second").to_numpy()
        if known:
            # All pairs but those of two main leaves, which are many and of one label.
            labels, main = t.column("label").to_numpy(), t.column("main").to_numpy()
            parts = [(~main, None), (main | True, main)] if second is None else [(~main | second, second), (main ^ second, second)]
            sets, leads = [np.frombuffer(x, np.uint32) for x in t.column("s").to_pylist()], _led_keys(fps)[:trie]
        else:
            labels, parts = None, [(np.ones(len(ids), bool), second)]

        def true(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether pairs that no trie before this one proposes are similar."""
            out = np.ones(len(i), bool)
            for lead in leads:
                out &= np.bitwise_count(lead[i] ^ lead[j]) > TRIE_ERRORS
            at = np.flatnonzero(out)
            out[at] = similar_sets(sets, i[at], j[at], similar)
            return out

        out = []
        for part, sides in parts:
            at = np.flatnonzero(part)
            i, j, sure, more = traverse(order[at], fps[at], [TRIE_ERRORS] * TRIE_BITS, LOOSE, d, None if sides is None else sides[at].astype(np.int64), TIGHT, None if labels is None else labels[at], None if labels is None else lambda i, j, at=at: true(at[i], at[j]))
            out.append((at[i], at[j], sure, more))
        i, j, sure, more = (np.concatenate(x) for x in zip(*out))
        a, b = ids[i], ids[j]
        apart = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int32)
        pa.default_memory_pool().release_unused()  # the worker goes on to smaller things
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": sure, "apart": apart, "more": more})

    keys = ["trie", "lo", "hi", "ba", "bb"]
    sent = leaves.select("low", "fp", *known).mapInArrow(send, "trie int, lo long, hi long, ba long, bb long, second boolean, key long, low long, fp binary" + (", label long, main boolean, s binary" if known else ""))
    found = sent.groupBy(*keys).applyInArrow(run, "a long, b long, sure boolean, apart int, more boolean")
    return found.groupBy("a", "b").agg(F.bool_or("sure").alias("sure"), F.min("apart").alias("apart"), F.bool_or("more").alias("more"))


def shingle_sets(ids: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, s): 32 bits of the hash of each distinct shingle, packed, of the documents with these ids."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.unique(shingle_hashes(t.as_py(), width).astype(np.uint32)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["id", "s"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).join(ids, "id", "left_semi")
    # Rows that share an id are judged by the least of their sets, whichever task meets them first.
    return texts.mapInArrow(sets, "id long, s binary").groupBy("id").agg(F.min("s").alias("s"))


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) of ids whose shingle sets have that similarity (Jaccard)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similar * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return written(both.select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long"), "verified")


#: Rounds in which every leaf has its closest candidate in another tree verified, before all that are left are.
ROUNDS = 3


def similar_trees(found: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(node, root) of the components of the candidates (a, b, sure, apart) that are similar.

    The sure ones are verified first, then each leaf's closest in another tree, a few times over, then every one that is left
    between two trees: in a group of near copies the first rounds join nearly all, so few are left.
    """
    left = written(found.select("a", "b", "sure", "apart"), "apart")
    trees = written(components(verified(left.where("sure"), sets, similar)), "trees")
    left = left.where("NOT sure").select("a", "b", "apart")
    for number in range(ROUNDS + 1):
        for end in "ab":
            left = left.join(trees.toDF(end, f"t{end}"), end, "left").withColumn(f"t{end}", F.coalesce(f"t{end}", end))
        left = written(left.where("ta <> tb"), "apart")
        if left.isEmpty():
            break
        if number == ROUNDS:
            now = left.select("a", "b")
        else:
            ends = [left.groupBy(x).agg(F.min(F.struct("apart", y)).alias("x")).select(F.least(x, f"x.{y}").alias("a"), F.greatest(x, f"x.{y}").alias("b")) for x, y in ("ab", "ba")]
            now = written(ends[0].union(ends[1]).distinct(), "tried")
        links = verified(now, sets, similar)
        if not links.isEmpty():
            trees = written(components(trees.toDF("a", "b").union(links)), "trees")
        left = left.join(now, ["a", "b"], "left_anti").select("a", "b", "apart")
    return trees


#: Leaves with their shingle sets that meet in one group: some 25 MB of sets of usual texts.
PER_NODE = 20_000


def closest_of_leaves(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the sure candidates and, of the others, those that are among an end's CLOSEST, ids of leaves that other candidates were left out of).

    Each trie's groups return as many of each leaf; verifying them once over all tries makes the work grow with the leaves, not with the tries.
    """
    rank = lambda end, other: F.row_number().over(Window.partitionBy("sure", end).orderBy("apart", other))
    keep = F.col("sure") | (F.col("ra") <= CLOSEST) | (F.col("rb") <= CLOSEST)
    ranked = written(found.withColumn("ra", rank("a", "b")).withColumn("rb", rank("b", "a")).select("a", "b", "sure", "apart", "more", keep.alias("keep")), "closest")
    return ranked.where("keep").drop("keep"), ranked.where("more OR NOT keep").select("a").distinct()


def unsettled(leaves: DataFrame, regions: DataFrame, cut: DataFrame, trees: DataFrame) -> DataFrame:
    """(low, fp, label, main): the leaves of regions (node, root) of candidates in which some were left out and more than one tree is.

    cut: ids ``a`` of leaves that candidates were left out of.  label: the leaf's tree; main: it is the region's largest.
    """
    cut = cut.join(regions, F.col("a") == F.col("node")).select(F.col("root").alias("region")).distinct()
    held = regions.select(F.col("node").alias("low"), F.col("root").alias("region")).join(cut, "region", "left_semi")
    held = held.join(trees.toDF("low", "label"), "low", "left").withColumn("label", F.coalesce("label", "low"))
    sizes = held.groupBy("region", "label").count().groupBy("region").agg(F.max_by("label", F.struct("count", "label")).alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = held.join(sizes, "region").select("low", "label", (F.col("label") == F.col("largest")).alias("main"))
    return written(leaves.join(held, "low").select("low", "fp", "label", "main"), "unsettled")


def near_copies(docs: DataFrame, width: int = 5, similar: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): groups of documents that links of at least that similarity connect; component_id is the smallest id.

    Null and empty texts are copies of each other.  Rows with a null id are left out; rows that share an id are one
    document, judged by the least of their shingle sets.  An empty table gives none.
    """
    known = docs.where(F.col(id_col).isNotNull())
    marks = written(fingerprints(known, width, WORDS64, id_col, text_col, with_set=True), "fingerprints")
    leaves = written(marks.groupBy("fp").agg(F.min(id_col).alias("low")), "leaves")
    found = written(candidate_links(leaves), "candidates")
    # Every candidate, also one left out, has both ends in one region.
    regions = written(components(found), "regions")
    found, cut = closest_of_leaves(found)
    ids = regions.select(F.col("node").alias("id"))
    sets = written(shingle_sets(ids, known, width, id_col, text_col), "shingles")
    roots = similar_trees(found, sets, similar)
    again = unsettled(leaves, regions, cut, roots)
    if not again.isEmpty():
        held = again.join(sets.toDF("low", "s"), "low")
        links = written(candidate_links(held, PER_NODE, similar).select("a", "b"), "links")
        roots = written(components(roots.toDF("a", "b").union(links)), "trees")
    named = leaves.join(roots, leaves.low == roots.node, "left").select("fp", F.coalesce("root", "low").alias("component_id"))
    return marks.join(named, "fp").groupBy(id_col).agg(F.min("component_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, similar: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of one document of each group of near copies: that with the smallest id.

    Of null and empty texts, which are copies, one stays; rows with a null id stay; rows that share an id stay or go together.
    """
    return without(docs, near_copies(docs, width, similar, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(id_col), id_col)
