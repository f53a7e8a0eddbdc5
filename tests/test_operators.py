from __future__ import annotations

import json
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hunkweave.functions import text as tx
from hunkweave.operators import diff, graph, joins, sequence
from hunkweave.plans.untangle import cosine
from hunkweave.sources import cases, git, sinks

EDGES = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25)


@settings(deadline=None, max_examples=200)
@given(EDGES)
def test_partition_covers_each_node_once(edges):
    edges = [e for e in edges if e[0] != e[1]]
    groups = graph.partition(list(range(10)), edges)
    assert sorted(v for _, g in groups for v in g) == list(range(10))
    reach = {v: {v} for v in range(10)}
    for _ in range(10):
        for a, b in edges:
            for v in reach:
                if a in reach[v]:
                    reach[v].add(b)
    strong = {frozenset(w for w in reach[v] if v in reach[w]) for v in range(10)}
    assert {frozenset(g) for k, g in groups if k == "strong"} == {g for g in strong if len(g) > 1}


@settings(deadline=None, max_examples=100)
@given(EDGES, st.permutations(range(10)))
def test_partition_is_the_same_under_other_names(edges, names):
    plain = graph.partition(list(range(10)), edges)
    other = graph.partition(list(range(10)), [(names[a], names[b]) for a, b in edges])
    assert {(k, frozenset(names[v] for v in g)) for k, g in plain} == {(k, frozenset(g)) for k, g in other}


WORDS = st.lists(st.text("ab \t", max_size=8), max_size=5)


@settings(deadline=None, max_examples=200)
@given(WORDS, WORDS)
def test_word_spans_lie_inside_their_lines(a, b):
    for line, begin, end_line, end in diff.word_spans(a, b):
        assert line == end_line and 1 <= begin <= end <= len(b[line]) and b[line][begin - 1 : end].strip()
    assert diff.word_spans(b, b) == []


@settings(deadline=None, max_examples=100)
@given(st.text("abc ", max_size=20), st.text("abc ", max_size=20))
def test_cosine_is_symmetric(a, b):
    assert cosine(a, b) == cosine(b, a) and -1e-9 <= cosine(a, b) <= 1 + 1e-9


def test_a_node_beside_a_strong_component_stays_outside(spark):
    edges = spark.createDataFrame([(1, 0, 1, "X"), (1, 1, 0, "X"), (1, 1, 2, "X"), (1, 3, 4, "X"), (1, 3, 4, "Y")], "case_id long, src long, dst long, etype string")
    nodes = spark.createDataFrame([(1, 5), (2, 0)], "case_id long, patch_id long")
    got = {tuple(r) for r in graph.partition_groups(nodes, edges).collect()}
    assert got == {(1, 0, 0), (1, 0, 1), (1, 2, 2), (1, 3, 3), (1, 3, 4), (1, 5, 5), (2, 0, 0)}
    assert {tuple(r) for r in graph.degrees(nodes, edges).where("patch_id = 3").collect()} == {(1, 3, 2, 0)}
    large = graph.weak_components_large(edges.select("src", "dst"))
    assert {tuple(r) for r in large.collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)}


def test_line_edits_ignore_amounts_of_white_space():
    assert diff.line_edits("a\nb c\nd\n", "a\nb   c\nd\n") == []
    assert diff.line_edits("a\r\nb\r\n", "a\nb\n") == []
    assert diff.line_edits("a\nb\n", "a\nx\nb\n") == [(1, 1, 1, 2)]
    assert diff.line_edits(None, "a\n") == [(0, 0, 0, 1)]


def test_tree_diff_and_renames(spark):
    schema = "case_id long, path string, blob_id string"
    left = spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (1, "c", "3"), (1, "d", "4"), (1, "e", "7")], schema)
    right = spark.createDataFrame([(1, "a", "1"), (1, "b", "9"), (1, "z", "3"), (1, "n", "5"), (1, "f", "8")], schema)
    entries = diff.tree_diff(left, right, ["case_id"])
    assert {(r.change_type, r.left_path, r.right_path) for r in entries.collect()} == {("MODIFY", "b", "b"), ("RENAME", "c", "z"), ("DELETE", "d", None), ("ADD", None, "n"), ("DELETE", "e", None), ("ADD", None, "f")}
    contents = spark.createDataFrame([("4", "p"), ("5", "q"), ("7", "1\n2\n3\n4"), ("8", "1\n2\n3\n5")], "blob_id string, content string")
    found = diff.similar_renames(entries, ["case_id"], contents)
    assert {(r.change_type, r.left_path, r.right_path) for r in found.collect()} == {("MODIFY", "b", "b"), ("RENAME", "c", "z"), ("DELETE", "d", None), ("ADD", None, "n"), ("RENAME", "e", "f")}


def test_patches_regions_and_spans(spark):
    rows = [(1, "MODIFY", "A.java", "A.java", "a\nfoo(1, 2)\nb", "a\nfoo(1,   3)\nb\nnew"), (1, "ADD", None, "B.java", None, "x\ny\n"), (1, "MODIFY", "C.txt", "C.txt", "a", "b")]
    files = spark.createDataFrame(rows, "case_id long, change_type string, left_path string, right_path string, left_content string, right_content string")
    patches = diff.line_patches(files, ["case_id"])
    got = {(r.patch_id, r.left and tuple(r.left), r.right and tuple(r.right)) for r in patches.collect()}
    assert got == {(0, ("A.java", 2, 2), ("A.java", 2, 2)), (1, ("A.java", 4, 3), ("A.java", 4, 4)), (2, None, ("B.java", 1, 2))}
    regions = diff.regions(patches, files, ["case_id"])
    assert {(r.patch_id, r.side): list(r.code) for r in regions.collect()}[(1, "L")] == []
    spans = {(r.patch_id, r.side, tuple(r.b), tuple(r.e)) for r in diff.token_spans(regions, ["case_id"]).collect()}
    assert spans == {(0, "L", (2, 8), (2, 9)), (0, "R", (2, 10), (2, 11)), (1, "R", (4, 1), (4, 3)), (2, "R", (1, 1), (3, 0))}


def test_overlap_join_equals_the_plain_condition(spark):
    rows = [(1, i, (i * 37) % 50, (i * 37) % 50 + i % 13 - 1) for i in range(40)]
    a = spark.createDataFrame(rows, "k int, a int, begin int, end int")
    b = a.toDF("k", "b", "b_begin", "b_end")
    got = sorted((r.a, r.b) for r in joins.overlap_join(a, b, ["k"], 8).collect())
    assert got == sorted((x[1], y[1]) for x in rows for y in rows if x[2] <= x[3] and y[2] <= y[3] and x[3] >= y[2] and x[2] <= y[3])


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.is_comment(F.array().cast("array<string>")).alias("a"), tx.is_comment(F.array(F.lit("// x"), F.lit(""), F.lit("* y"))).alias("b"), tx.is_comment(F.array(F.lit("x"))).alias("c"),
        tx.stripped(F.lit("\t x \t")).alias("d"), tx.remove_tail(F.lit("abc"), 5).alias("e"), tx.before_char(F.lit("a.b.c"), ".").alias("f"), tx.miner_path(F.lit(None).cast("string")).alias("g"),
        tx.miner_path(F.lit("x/src/main/java/A.java")).alias("h"), tx.is_valid_path(F.lit("src/main/java/中.java")).alias("i"), tx.source_root(F.lit("m/src/test/java/p/A.java")).alias("j"), tx.is_platform_import(F.lit("javax.x")).alias("k"), tx.hunk_count(F.lit("@@ a\nb\n@@ c")).alias("l"),
    ).first()
    assert tuple(row) == (True, True, False, "x", "", "a", True, True, False, "m/src/test/java", True, 2)


def test_group_json_keeps_missing_sides(spark):
    schema = "case_id long, group_id long, patch_id long, left struct<path:string,begin:int,end:int>, right struct<path:string,begin:int,end:int>"
    rows = spark.createDataFrame([(4, 0, 0, ("a", 1, 2), None), (4, 0, 2, None, ("b", 3, 2)), (4, 1, 1, ("a", 5, 5), ("a", 5, 6))], schema)
    got = json.loads(sinks.group_json(rows).first().json)
    assert got == {"groups": [[{"leftPath": "a", "leftBegin": 1, "leftEnd": 2, "rightPath": None}, {"leftPath": None, "rightPath": "b", "rightBegin": 3, "rightEnd": 2}], [{"leftPath": "a", "leftBegin": 5, "leftEnd": 5, "rightPath": "a", "rightBegin": 5, "rightEnd": 6}]], "index": 4}


def test_timing_summary_without_success(spark):
    rows = spark.createDataFrame([(1, 5, False), (1, 6, False), (1, 9, True), (2, 7, True)], "k int, ms long, failed boolean")
    got = {tuple(r) for r in sinks.timing_summary(rows, ["k"], F.col("ms"), F.col("failed")).collect()}
    assert got == {(1, 3, 1, 11, 5), (2, 1, 1, 0, None)}


def test_mining_a_repository(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *args], check=True, capture_output=True)

    run("init", "-q")
    folder = tmp_path / "src/main/java"
    folder.mkdir(parents=True)
    for i in range(4):
        (folder / f"A{i}.java").write_text(f"class A{i} {{ }}\n")
        run("add", "-A")
        run("commit", "-qm", str(i))
    (tmp_path / "README").write_text("x")
    run("add", "-A")
    run("commit", "-qm", "no source")
    history = git.commits(spark, str(tmp_path), "r")
    chains = sequence.mine_chains(git.commit_diffs(history, str(tmp_path))).collect()
    shas = [r.sha for r in history.orderBy("seq").collect()]
    assert [(r.repo, r.case_id, r.hashes) for r in chains] == [("r", 0, [s[:10] for s in shas[:4]])]
    cases.write_cases(spark.createDataFrame(chains), str(tmp_path / "out"))
    read = cases.read_cases(spark, str(tmp_path / "out/repo=r"), "r")
    assert [tuple(r) for r in read.collect()] == [("r", 0, [s[:10] for s in shas[:4]])]
    files = git.files(read, str(tmp_path))
    assert {(r.side, r.path[-7:], r.content) for r in files.collect()} == {("R", f"A{i}.java", f"class A{i} {{ }}\n") for i in (1, 2, 3)}
    with pytest.raises(FileNotFoundError):
        git.open_repository(str(tmp_path / "none"))


def test_clones_of_a_hot_key_meet_in_blocks(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy cat", "nothing of the kind is written here", "ab", "ab"]
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "k string, id long, t string")
    whole = {tuple(r) for r in joins.clone_pairs(rows, ["k"], "id", "t").collect()}
    assert whole == {("k", 0, 1)} == {tuple(r) for r in joins.clone_pairs(rows, ["k"], "id", "t", block=1).collect()}
    assert {tuple(r) for r in joins.clone_classes(rows, ["k"], "id", "t").collect()} == {("k", 0, 0), ("k", 1, 1), ("k", 2, 2), ("k", 3, 3), ("k", 4, 3)}


def test_miner_limits_are_those_of_one_commit():
    from hunkweave.operators.sequence import MinerChain

    def diffs(*paths):
        return [{"a_path": a, "b_path": b, "n_hunks": 1, "valid": True} for a, b in paths]

    chain = MinerChain()
    chain.start({"sha": "0"})
    # Two files each, four in the chain: the limit of three is each commit's own.
    assert chain.take({"sha": "1", "parents": ["0"], "diffs": diffs(("a", "a2"), ("b", "b2"))})
    assert chain.take({"sha": "2", "parents": ["1"], "diffs": diffs(("c", "c2"), ("d", "d2"))})
    # An added file and a deleted one share no path.
    assert chain.take({"sha": "3", "parents": ["2"], "diffs": diffs((None, "new"))})
    assert chain.take({"sha": "4", "parents": ["3"], "diffs": diffs(("gone", None))})
    assert not chain.take({"sha": "5", "parents": ["4"], "diffs": diffs(("a2", "x"))})
    assert not chain.take({"sha": "5", "parents": ["4"], "diffs": diffs(("x", "a"))})
    assert not chain.take({"sha": "5", "parents": None, "diffs": diffs(("x", "y"))})


def test_facts(spark):
    from hunkweave.operators import facts

    puts = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "d", 1)], "node long, value string, seq int")
    known = facts.latest(puts, ["node"], "value", ["seq"])
    assert {tuple(r) for r in known.collect()} == {(1, "b"), (2, "c"), (None, "d")}
    pairs = spark.createDataFrame([(10, 1), (11, 3)], "to long, node long")
    assert [tuple(r) for r in facts.assign(known, pairs, ["node"], "value").collect()] == [(10, "b")]
    assert [r.to for r in facts.if_known(pairs, known, ["node"]).collect()] == [10]
    assert facts.merged(known, known).count() == 3
    assert [r.line for r in facts.rendered(puts.where("node = 1"), ["node"], ["seq"], F.col("value")).collect()] == ["[a, b]"]


def test_span_join_equals_the_plain_condition(spark):
    import random

    from hunkweave.operators.joins import inside, span_join

    random.seed(3)
    point = lambda x: (x // 50, x % 50)
    rows = [(i, 0, point(a), point(a + random.randrange(9_000 if i % 9 == 0 else 60))) for i in range(60) for a in [random.randrange(20_000)]]
    nodes = spark.createDataFrame(rows, "id long, f int, b struct<line:int,col:int>, e struct<line:int,col:int>")
    spans = nodes.select("f", F.col("id").alias("other"), F.col("b").alias("sb"), F.col("e").alias("se"))
    got = {(r.id, r.other) for r in span_join(nodes, spans, ["f"]).collect()}
    assert got == {(x[0], y[0]) for x in rows for y in rows if x[3] >= y[2] and x[2] <= y[3]}
    lines = nodes.select("id", "f", F.col("b.line").alias("b_line"), F.col("e.line").alias("e_line"))
    regions = spark.createDataFrame([(0, 10, 20), (0, 300, 299)], "f int, begin int, end int")
    assert {r.id for r in inside(lines, regions, ["f"], ["id"]).collect()} == {x[0] for x in rows if x[2][0] <= 20 and x[3][0] >= 10}


def test_chains_of_a_long_history_are_the_same_in_blocks(spark):
    import random

    r = random.Random(5)
    file = lambda: {"a_path": r.choice("abcdefgh"), "b_path": r.choice("abcdefgh"), "n_hunks": r.randrange(7), "valid": r.random() < 0.9}
    rows = []
    for repo, n in (("x", 400), ("y", 1), ("z", 37)):
        for i in range(n):
            rows.append((repo, i + 3, f"{repo}{i}", [f"{repo}{i - 1}"] if i and r.random() < 0.9 else [], [file() for _ in range(r.choice([0, 1, 1, 1, 2, 2, 3, 4]))]))
    commits = spark.createDataFrame(rows, "repo string, seq long, sha string, parents array<string>, diffs array<struct<a_path:string,b_path:string,n_hunks:long,valid:boolean>>").repartition(3)
    carry = ["sha", "parents", "diffs"]
    want = {tuple(x) for x in sequence.greedy_segments(commits, ["repo"], ["seq"], carry, sequence.MinerChain, "repo string, seq long, segment long").collect()}
    for block in (7, 16, 4096):
        assert {tuple(x) for x in sequence.pointer_segments(commits, ["repo"], "seq", carry, sequence.MinerChain, 5, block).collect()} == want
