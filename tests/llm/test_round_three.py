"""Sharding, Merkle manifests and vector codes against brute force, and what they give for odd rows."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hunkweave.llm import kdcodes, merkle, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


# -- sharding


def placed_plainly(loads, shards, weights=sharding.WEIGHTS):
    left, out = [[1.0] * 3 for _ in range(shards)], [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i][0], -sum(loads[i]), i)):
        dots = [sum(w * a * b for w, a, b in zip(weights, loads[i], x)) for x in left]
        out[i] = at = max(range(shards), key=lambda s: (dots[s], -s))
        left[at] = [a - b for a, b in zip(left[at], loads[i])]
    return out


def test_placement_against_plain_loops():
    r = np.random.default_rng(2)
    loads = r.integers(1, 64, (300, 3)) / 2048  # exact in doubles, so that dot products tie alike
    assert sharding.place(loads, 7, (2.0, 1.0, 1.0)).tolist() == placed_plainly(loads.tolist(), 7, (2.0, 1.0, 1.0))


def shards_of(rows, n):
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(r)
    assert set(held) <= set(range(n))
    for own in held.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return held


def test_shards_are_even_and_groups_whole(spark, monkeypatch):
    r = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 999, int(n))) for n in r.pareto(1.5, 3000) * 20 + 1]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(10_000 + i, texts[5], "en", "s", 1) for i in range(9)]
    rows += [(20_000 + i, "a hot text of a few words", "en", "s", 1) for i in range(1500)]  # a third of all rows
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("clash")).withColumn("group_of_row", F.lit("clash")).withColumn("start", F.lit(1))
    monkeypatch.setattr(sharding, "NUMBERED", 10)  # items are numbered by runs
    got = sharding.assign(docs, 8)
    assert got.columns == [*[c for c in docs.columns if c != "shard"], "shard", "slot"]
    got = got.collect()
    assert sorted(x.doc_id for x in got) == sorted(x[0] for x in rows)
    held = shards_of(got, 8)
    size = [sum(len(x.text.encode()) + 16 for x in own) for own in held.values()]
    assert len(size) == 8 and max(size) < 1.02 * sum(size) / 8 and min(size) > 0.98 * sum(size) / 8
    at = defaultdict(set)
    for x in got:
        at[x.text].add(x.shard)
    assert [t for t, s in at.items() if len(s) > 1] == ["a hot text of a few words"]
    assert max(len(own) for own in held.values()) < 1.5 * len(rows) / 8


def test_shards_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, None, None, None, None), (None, "a", None, None, 1), (2, "", "x", "s", 0), (2, "", "x", "s", 0), (3, "b " * 30_000, "x", "s", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.assign(docs, 3).collect()
    assert len(got) == 6
    shards_of(got, 3)
    assert sharding.assign(docs.limit(0), 3).count() == 0
    back = sharding.write(docs, 3)
    assert sorted(map(str, back.select(*docs.columns, "shard", "slot").collect())) == sorted(map(str, got))
    by_count = sharding.assign(docs.withColumn("tok", F.lit(5)), 2, tokens_col="tok")
    shards_of(by_count.collect(), 2)


# -- manifests


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def tree(nodes):
    """Levels from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append("" if j >= len(level) else ("R" if j > i else "L") + level[j])
        i //= 2
    return out


def brute_manifest(rows):
    def leaf(row):
        d = dict(zip(SCHEMA.replace(" long", "").replace(" string", "").split(", "), row))
        return h(*["-" if d[c] is None else f"{len(str(d[c]).encode())}:{d[c]}" for c in COLUMNS])

    parts = defaultdict(list)
    for row in rows:
        parts[row[2]].append((row[0] is not None, row[0] or 0, leaf(row), row[0]))
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[2] for x in sorted(v, key=lambda x: x[:3])]) for k, v in parts.items()}
    crown = tree([trees[k][-1][0] for k in names])
    out = []
    for at, k in enumerate(names):
        for i, x in enumerate(sorted(parts[k], key=lambda x: x[:3])):
            out.append((x[3], k, x[2], trees[k][-1][0], crown[-1][0], tuple(path(trees[k], i) + path(crown, at))))
    return out


@pytest.mark.parametrize("tier", [1, 2, 10])
def test_manifest_against_brute_force(spark, tier, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 7)  # several ranges a part
    rows = [(i * 3 % 41, f"text {i} é", "en" if i % 3 else "de", None if i % 4 else "s", i) for i in range(41)]
    rows += [(5, None, None, "s", None), (None, "x", None, "", 1), (None, "y", None, "", 1), (7, "", "Éa", "s", 0), (8, "", "", "s", 0), (8, "", "", "s", 0), (9, "z" * 100_000, "zz", "s", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("clash")).withColumn("hash", F.lit(0)).withColumn("part", F.lit(0))
    got = [(r.id, r.part, r.leaf, r.subroot, r.root, tuple(r.steps)) for r in merkle.manifest(docs, COLUMNS, "lang", "doc_id", tier=tier).collect()]
    assert sorted(got, key=str) == sorted(brute_manifest(rows), key=str)


def test_proofs_show_tampering(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    other = merkle.leaf(*[F.lit("forged") if c == "text" else F.col(c) for c in COLUMNS])
    got = merkle.verify(merkle.manifest(docs, COLUMNS, "lang", "doc_id", shown=F.when(F.col("doc_id") == 3, other))).collect()
    assert {r.id: r.verified for r in got} == {0: True, 1: True, 2: True, 3: False, 4: True}
    assert all(r.proof_sha256 == h(*[s[1:] for s in r.steps]) for r in got)
    assert len({r.folded_root for r in got}) == 2
    assert merkle.verify(merkle.manifest(docs.limit(0), COLUMNS, "lang", "doc_id")).count() == 0
    one = merkle.verify(merkle.manifest(docs.limit(1), COLUMNS, "lang", "doc_id")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].root and one[0].verified and one[0].steps == []


# -- codes


def brute_codes(rows, scale=256, parts=16, entries=64, rounds=2):
    kept = [(i, np.floor(scale * np.array(v, np.float64)).astype(np.int64), label) for i, v, label in rows if v is not None and len(v) and len(v) % parts == 0 and all(x is not None and np.isfinite(x) and abs(x) < 1e6 for x in v)]
    out = []
    for dim in {len(v) for _, v, _ in kept}:
        own = [x for x in kept if len(x[1]) == dim]
        first = sorted(own, key=lambda x: (x[0] is None, x[0] or 0, x[1].astype("<i8").tobytes()))[:entries]
        x = np.stack([v for _, v, _ in own]).reshape(len(own), parts, -1)
        book = np.stack([v for _, v, _ in first]).reshape(len(first), parts, -1)
        for r in range(rounds + 1):
            far = ((x[:, None] - book[None]) ** 2).sum(axis=3)
            near = far.argmin(axis=1)
            if r < rounds:
                new = book.copy()
                for p in range(parts):
                    for e in set(near[:, p].tolist()):
                        took = x[near[:, p] == e, p]
                        new[e, p] = took.sum(axis=0) // len(took)
                book = new
        digest = hashlib.sha256(",".join(str(c) for p in range(parts) for e in book[:, p].tolist() for c in e).encode()).hexdigest()
        for k, (i, _, label) in enumerate(own):
            out.append([i, "".join(f"{c:02x}" for c in near[k]), int(far[k].min(axis=0).sum()), label, digest])
    total = defaultdict(int)
    for x in out:
        total[x[3]] += x[2]
    return sorted([(x[0], x[1], x[2], total[x[3]], x[4]) for x in out], key=str)


SHAPE = "vec_id long, embedding array<float>, label int"


def test_codes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kdcodes, "BLOCK", 150)
    r = np.random.default_rng(3)
    smooth = [(i, [float(x) for x in r.normal(0, 0.3, 32)], int(r.integers(0, 3))) for i in range(500)]
    tied = [(1000 + i, [float(x) / 256 for x in r.integers(-2, 3, 32)], None) for i in range(400)]  # many equal distances and equal parts
    odd = [(2000, None, 1), (2001, [None] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [float("inf")] * 32, 1), (2004, [], 1), (2005, [1.0] * 31, 1), (None, [0.5] * 32, 1), (3, [0.25] * 32, 2), (3, [0.25] * 32, 2), (2006, [3e38] * 32, 1), (2007, [1.0] * 16, 1), (2008, [2.0] * 16, None)]
    rows = smooth + tied + odd
    vectors = spark.createDataFrame(rows, SHAPE).withColumn("v", F.lit("clash")).withColumn("id", F.lit("clash")).withColumn("code", F.lit(1)).repartition(3)
    got = kdcodes.compress(vectors)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows)
    assert kdcodes.compress(vectors.limit(0)).count() == 0
    assert kdcodes.compress(vectors.where("vec_id = 2000")).count() == 0


def test_whole_subtrees_are_assigned_at_once():
    r = np.random.default_rng(4)
    points = (r.integers(0, 4, (4000, 1)) * 10_000 + r.integers(0, 9, (4000, 3))).astype(np.int64)
    entries = np.array([[k * 10_000] * 3 for k in range(4)], np.int64)
    tree_ = kdcodes.PartTree(points)
    single = sum(len(which) for which, _, level in tree_.filter(entries) if level < 0)
    assert single < 200  # the rest went as subtrees
    far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (tree_.codes(entries) == far.argmin(axis=1)).all()
    total, count = tree_.sums(entries)
    assert all((points[far.argmin(axis=1) == e].sum(axis=0) == total[e]).all() for e in range(4)) and count.sum() == 4000


def test_codes_are_decoded(spark):
    rows = [(i, [float(i + k) for k in range(16)], 0) for i in range(5)]
    vectors = kdcodes.quantized(spark.createDataFrame(rows, SHAPE), 1.0, 16, "vec_id", "embedding", None)
    book = kdcodes.train(vectors, 16, 16, 64, 2)
    got = {r.id: r.vector for r in kdcodes.decode(kdcodes.encode(vectors, book), book).collect()}
    assert got == {i: [i + k for k in range(16)] for i in range(5)}
