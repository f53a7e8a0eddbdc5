"""No candidate of the near-dedup is left unverified between two groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hunkweave.llm import simhash


def test_candidates_far_from_the_closest_are_verified(spark):
    # Windows of which only consecutive ones are similar: a chain of 0-5 and one of 12-7, tied by the pair that is farthest in bits.
    windows = {**{k: k for k in range(6)}, **{10 + k: 11 - k for k in range(6)}}
    sets = spark.createDataFrame([(i, np.arange(8 * w, 8 * w + 100, dtype=np.uint32).tobytes()) for i, w in windows.items()], "id long, s binary")
    sure = [(s + k, s + k + 1, True, 10) for s in (0, 10) for k in range(5)]
    rest = [(a, 10 + b, False, 30 + a + b) for a in range(6) for b in range(6)]
    found = spark.createDataFrame(sure + rest, "a long, b long, sure boolean, apart int")
    got = {r.node: r.root for r in simhash.similar_trees(found, sets, 0.8).collect()}
    assert got == dict.fromkeys(windows, 0)


def test_copies_that_repeat_a_line_are_found(spark):
    r = np.random.default_rng(7)
    own = [f"w{x}" for x in r.integers(0, 10**6, 504)]
    line = own[100:110]
    rows = [(n, " ".join(own[:110] + line * n + own[110:])) for n in (0, 10, 100)] + [(7, " ".join(own[250:] + line * 100))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 10: 0, 100: 0, 7: 7}


def test_pairs_behind_false_sure_links_are_verified(spark, monkeypatch):
    # All fingerprints are within TIGHT bits of each other, so the first search returns trees of them; only 17 and 29 are similar.
    rows = [(i, " ".join(f"d{17 if i == 29 else i}w{k}" for k in range(50)) + (" end" if i == 29 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i.to_bytes(32, "big") + bytes([i] * 8)) for i in range(40)], "doc_id long, fp binary")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **b: marks)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {i: 17 if i == 29 else i for i in range(40)}


def test_pairs_58_bits_apart_are_proposed(spark):
    marks = spark.createDataFrame([(0, bytes(40)), (1, bytes(24) + b"\xff" * 7 + b"\xc0" + b"\x01" * 8)], "low long, fp binary")
    assert [(r.a, r.b, r.apart) for r in simhash.candidate_links(marks).collect()] == [(0, 1, 58)]
