"""Components by joins against the search in a task."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hunkweave.operators import graph, large_graph

EDGES = "case_id long, src long, dst long"


def plain(edges):
    out = set()
    for case in {c for c, _, _ in edges}:
        own: dict[int, list[int]] = {}
        for c, a, b in edges:
            if c == case:
                own.setdefault(a, []).append(b)
        for g in graph.strong_components(sorted({x for c, a, b in edges if c == case for x in (a, b)}), own):
            if len(g) > 1:
                out |= {(case, v, min(g)) for v in g}
    return out


def shapes():
    r = random.Random(3)
    ring = [(1, i, (i + 1) % 40) for i in range(40)]  # a cycle of inner nodes alone
    pair = [(1, 100, 101), (1, 101, 100)]
    path = [(2, i, i + 1) for i in range(300)]  # nothing in a cycle
    loop = [(2, 1000 + i, 1000 + (i + 1) % 50) for i in range(50)] + [(2, 1000, 2000), (2, 2000, 1000), (2, 1010, 3000)]
    back = [(3, i, i + 1) for i in range(60)] + [(3, 60, 20), (3, 30, 5), (3, 7, 7)]
    dense = [(4, r.randrange(30), r.randrange(30)) for _ in range(45)]
    sparse = [(5, r.randrange(400), r.randrange(400)) for _ in range(520)]
    return ring + pair + path + loop + back + dense + sparse


@pytest.mark.parametrize("small", [0, 60])
def test_strong_components_by_joins(spark, small):
    edges = shapes()
    got = large_graph.strong_components_large(spark.createDataFrame(edges, EDGES).coalesce(2), small)
    assert {tuple(r) for r in got.collect()} == plain([e for e in edges if e[1] != e[2]])
    assert got.count() == len({tuple(r) for r in got.collect()})


def test_large_cases_are_partitioned_alike(spark):
    edges = spark.createDataFrame(shapes(), EDGES).withColumn("etype", F.lit("DEPEND")).coalesce(2)
    nodes = spark.createDataFrame([(1, 999), (5, 7), (6, 0)], "case_id long, patch_id long")
    rows = lambda df: {tuple(r) for r in df.select("case_id", "group_id", "patch_id", "kind").collect()}
    assert rows(graph._partitioned(nodes, edges)) == rows(graph._partitioned(nodes, edges, small=100))


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert large_graph.strong_components_large(none).count() == 0
    assert {tuple(r) for r in graph.partition_groups(spark.createDataFrame([(1, 4)], "case_id long, patch_id long"), none).collect()} == {(1, 4, 4)}


@pytest.mark.parametrize("small", [0, large_graph.SMALL])
def test_classes_stand_for_all_their_pairs(spark, small):
    r = random.Random(9)
    classes = [(c, k, v) for c in range(6) for k in range(2) for v in r.sample(range(20), r.randrange(2, 7))]
    edges = [(c, r.randrange(20), r.randrange(20)) for c in range(6) for _ in range(9)]
    pairs = [(c, a, b) for c, k, a in classes for d, m, b in classes if (c, k) == (d, m) and a > b]
    df = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(2)
    nodes = df([(c, v) for c in range(6) for v in range(20)], "case_id long, patch_id long")
    rows = lambda x: {tuple(y) for y in x.select("case_id", "group_id", "patch_id", "kind").collect()}
    assert rows(graph._partitioned(nodes, df(edges, EDGES), small, df(classes, "case_id long, class_id long, patch_id long"))) == rows(graph._partitioned(nodes, df(edges + pairs, EDGES)))


def test_cases_dealt_as_a_whole_and_by_nodes(spark):
    edges = [e for e in shapes() if e[0] == 4] + [(1, i, (i + 1) % 5) for i in range(5)] + [(1, 5, 0), (1, 6, 7), (1, 7, 6)]
    got = large_graph.strong_components_large(spark.createDataFrame(edges, EDGES).coalesce(2), small=0, whole=20).collect()  # case 4 has more
    assert {tuple(r) for r in got} == plain([e for e in edges if e[1] != e[2]]) and len(got) == len(set(got))


def test_no_join_moves_a_case_dealt_as_a_whole(spark, monkeypatch):
    real, plans = large_graph.Dealt, []

    class Told(real):
        def __init__(self, df, *rest):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            super().__init__(df, *rest)

        def add(self, df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            super().add(df)

    monkeypatch.setattr(large_graph, "Dealt", Told)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        edges = [(c, i, (i + 1) % 6) for c in range(9) for i in range(6)] + [(c, 2, 0) for c in range(9)] + [(c, 1, 4) for c in range(9)]
        got = large_graph.strong_components_large(spark.createDataFrame(edges, EDGES).coalesce(2), small=0).collect()
    finally:
        spark.conf.set(key, before)
    assert {tuple(r) for r in got} == {(c, i, 0) for c in range(9) for i in range(6)}
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Exchange" in p for p in plans)
