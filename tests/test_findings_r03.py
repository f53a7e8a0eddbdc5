"""What the reviewer of round 3 found."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hunkweave.operators import joins, sequence


def test_chains_of_six_cross_blocks_shorter_than_the_look(spark):
    file = lambda k: [{"a_path": f"F{k}", "b_path": f"F{k}", "n_hunks": 1, "valid": True}]
    rows = [("r", k, str(k), [str(k - 1)] if k else [], file(k)) for k in range(20)]
    commits = spark.createDataFrame(rows, "repo string, seq long, sha string, parents array<string>, diffs array<struct<a_path:string,b_path:string,n_hunks:int,valid:boolean>>")
    for block in (1, 2, 3, 4):
        got = sequence.pointer_segments(commits, ["repo"], "seq", ["sha", "parents", "diffs"], sequence.MinerChain, 5, block).collect()
        assert {r.seq: r.segment for r in got} == {k: k // 6 for k in range(20)}, block


@pytest.mark.parametrize("block", [2048, 3])
def test_clone_pairs_of_texts_of_white_space_and_of_any_plane(spark, block):
    texts = {0: "   ", 1: "\n\n\n", 2: "abcdef", 3: "abcdef abcdef", 4: "\U0001f600\U0001f601\U0001f602x", 5: "\U0001f600\U0001f601\U0001f602", 6: "abcdef  abcdef", 7: "ab " * 9000}
    rows = spark.createDataFrame([("k", k, t) for k, t in texts.items()], "k string, id long, t string")
    assert {tuple(r) for r in joins.clone_pairs(rows, ["k"], "id", "t", block=block).collect()} == {("k", 2, 3), ("k", 2, 6), ("k", 3, 6)}


def test_a_text_is_sent_to_few_blocks(spark):
    rows = spark.range(2000).select(F.lit("k").alias("k"), "id", F.concat(F.lit("some text "), F.md5(F.col("id").cast("string").cast("binary"))).alias("t"))
    assert joins.dealt_to_blocks(rows, ["k"], "id", "t").count() == 2000  # blocks of 256 had each text eight times


def test_rounds_of_types_are_dealt_by_their_rows(spark, monkeypatch):
    from hunkweave.operators import java_types
    from hunkweave.operators.java_edges import Program
    from hunkweave.sources.java import parse_files

    real, plans = java_types.written, []

    def kept(df, name):
        if name == "typed":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(java_types, "written", kept)
    text = "class A { A next; A step() { return next; } void go() { step().next.step(); } }"
    edges = Program(parse_files(spark.createDataFrame([(0, "R", "A.java", text)], "case_id long, side string, path string, content string"))).edges()
    assert edges.where("etype = 'METHOD_CALL'").count() == 2
    assert plans and all("REPARTITION_BY_NUM" in p for p in plans)


def test_places_of_tokens_after_comments_and_text_blocks():
    from hunkweave.sources.java import parse

    found = {n.name: (n.begin, n.end) for n in parse('/* a\n b */ class A {\n  String s = """\n    x""" + t; // y\n\n  int t;\n}') if n.kind == "Variable" or n.kind == "Name"}
    assert found["s"][0] == (3, 10) and found["t"][0] == (6, 7) and found["s"][1] == (4, 12)


def test_more_line_items_are_more_tasks_of_steps(spark, tmp_path, monkeypatch):
    from hunkweave.plans import queries

    monkeypatch.setattr(queries, "STEP_ROWS", 2, raising=False)
    day = F.to_date(F.lit("1995-01-01"))
    orders = spark.range(8).select(F.col("id").alias("o_orderkey"), (F.col("id") % 4).alias("o_custkey"), day.alias("o_orderdate"))
    lines = spark.range(16).select((F.col("id") % 8).alias("l_orderkey"), F.col("id").alias("l_linenumber"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), F.lit(1.0).alias("l_extendedprice"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert queries._steps(spark, str(tmp_path)).rdd.getNumPartitions() == 8
    assert queries.degrees(spark, str(tmp_path)).count() == 16


def test_covers_are_dealt_by_their_rows(spark, monkeypatch):
    from hunkweave.plans import queries

    monkeypatch.setattr(queries, "STEP_ROWS", 2_000, raising=False)
    plan = queries.cover_lift(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert any("REPARTITION_BY_NUM" in line and "node_id" in line for line in plan.splitlines())


def test_only_what_a_chain_may_take_is_sent_to_the_miner(spark):
    file = lambda k, n, valid=True: {"a_path": f"F{k}", "b_path": f"F{k}", "n_hunks": n, "valid": valid}
    diffs = [None, [file(1, 5)], [file(2, 6)], [file(k, 1) for k in range(4)], [file(3, 1), file(4, 1, False)], [file(5, 1, False)], [file(6, 1)], [file(7, 1)], [file(8, 1)]]
    rows = [("r", k, str(k), [str(k - 1)] + ["other"] * (k == 6), d) for k, d in enumerate(diffs)]
    commits = spark.createDataFrame(rows, "repo string, seq long, sha string, parents array<string>, diffs array<struct<a_path:string,b_path:string,n_hunks:int,valid:boolean>>")
    sent = {r.seq: r.diffs and len(r.diffs) for r in sequence.what_may_follow(commits).collect()}
    assert sent == {0: None, 1: 1, 2: None, 3: None, 4: 1, 5: None, 6: None, 7: 1, 8: 1}
    assert [r.hashes for r in sequence.mine_chains(commits).collect()] == [["6", "7", "8"]]


def test_lines_move_once_to_their_anchors(spark, monkeypatch):
    from hunkweave.operators import diff

    real, plans = diff.written, []

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return real(df, name)

    monkeypatch.setattr(diff, "written", kept)
    rows = [(0, side, k, v) for side, text in (("L", "axbycx"), ("R", "aybxcxd")) for k, v in enumerate(text)]
    got = diff.joined_edits(spark.createDataFrame(rows, "f int, side string, pos int, value string"), ["f"]).collect()
    assert sorted(tuple(r)[1:] for r in got) == diff.sequence_edits("axbycx", "aybxcxd")
    assert {n for name, n in plans if name == "anchors"} == {1}


def test_lines_of_renamed_files_go_by_a_number(spark, monkeypatch):
    from hunkweave.operators import diff

    real, seen = diff.written, {}
    monkeypatch.setattr(diff, "written", lambda df, name: seen.setdefault(name, real(df, name)))
    contents = spark.createDataFrame([("x" * 40, "a\nb\nc\nd"), ("y" * 40, "a\nb\nc\ne")], "blob_id string, content string")
    entries = spark.createDataFrame([(1, "DELETE", "o", None, "x" * 40, None), (1, "ADD", None, "n", None, "y" * 40), (1, "ADD", None, "m", None, "y" * 40)], "case_id int, change_type string, left_path string, right_path string, left_blob string, right_blob string")
    got = {tuple(r) for r in diff.similar_pairs(entries, ["case_id"], contents).collect()}
    assert got == {(1, "o", p, "x" * 40, "y" * 40, 0.75) for p in "nm"}
    assert dict(seen["lines"].dtypes) == {"b": "bigint", "line": "string", "n": "int"} and seen["pairs"].count() == 1
