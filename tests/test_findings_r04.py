"""What the reviewer of round 4 found."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from hunkweave.operators import sequence

FILE = "array<struct<a_path:string,b_path:string,n_hunks:int,valid:boolean>>"


def final_plan(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_commits_are_not_sent_whole_by_way_of_the_driver(spark):
    k = F.col("id") % 10
    name = F.col("id").cast("string")
    file = F.array(F.struct(name.alias("a_path"), name.alias("b_path"), F.lit(1).alias("n_hunks"), F.lit(True).alias("valid"))).cast(FILE)
    before = F.when(k > 0, F.array((F.col("id") - 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    commits = spark.range(2000).select(F.expr("cast(id div 10 AS string)").alias("repo"), k.alias("seq"), name.alias("sha"), before.alias("parents"), file.alias("diffs"))
    chains = sequence.mine_chains(commits)
    assert sorted(len(r.hashes) for r in chains.collect()) == [4] * 200 + [6] * 200
    plan = final_plan(chains)
    assert re.search(r"SortMergeJoin.*\[repo#\d+, seq#", plan) and not re.search(r"BroadcastHashJoin \[repo#\d+, seq#", plan)


def test_a_table_of_many_equal_texts_is_not_sent_whole(spark):
    from hunkweave.sources.tables import written

    text = F.lit("some line of code\n" * 20)
    many = written(spark.range(70_000).select("id", text.alias("content"), F.array(text).alias("code")), "many")
    other = written(spark.range(70_000).select("id", F.lit(1).alias("x")), "other")
    few = written(spark.range(50).select("id", F.lit(1).alias("x")), "few")
    for kind, partner in (("left_semi", other), ("inner", spark.range(70_000))):
        met = many.select("id", "content").join(partner, "id", kind)
        assert len(met.collect()) == 70_000
        assert "Broadcast" not in final_plan(met), kind  # its file has some kilobytes
    met = spark.range(100).join(few, "id")
    assert met.count() == 50 and "BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString()


def plain_word_spans(a, b):  # noqa: ANN001, ANN201
    """By the definition, word by word."""
    from hunkweave.operators.diff import sequence_edits

    place = [(w.group(), i, w.start() + 1, w.end()) for i, line in enumerate(b) for w in re.finditer(r"\S+", line)]
    out = []
    for _, _, lo, hi in sequence_edits([w for line in a for w in line.split()], [p[0] for p in place]):
        for _, i, c, d in place[lo:hi]:
            if out and out[-1][0] == i and not b[i][out[-1][3] : c - 1].strip():
                out[-1] = (i, out[-1][1], i, d)
            else:
                out.append((i, c, i, d))
    return out


def test_words_of_a_text_are_read_once_for_all_its_pairs(spark):
    import random

    from hunkweave.operators.diff import word_spans, words_of

    random.seed(4)
    asked: list[str] = []

    def words(line: str):  # noqa: ANN202
        asked.append(line)
        return words_of(line)

    from functools import cache

    told = cache(words)
    line = lambda: random.choice(["", " ", "\t"]) + random.choice([" ", "  ", "\x1c"]).join(random.choices("abcdefgh", k=random.randint(0, 9))) + random.choice(["", " "])
    texts = [[line() for _ in range(random.randint(0, 5))] for _ in range(40)]
    for a in texts:
        for b in texts:
            assert word_spans(a, b, told) == plain_word_spans(a, b) == word_spans(a, b)
    assert len(asked) == len({s for t in texts for s in t})


def test_a_pair_of_texts_is_diffed_once_for_both_sides(spark, tmp_path):
    from hunkweave.plans import queries

    text = lambda k: F.concat(F.lit("one two three four five six seven eight nine ten\nand a last line "), k.cast("string"))
    spark.range(6).select(F.col("id").alias("doc_id"), text(F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(60).alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spans = queries.word_diff_spans(spark, str(tmp_path))
    rows = spans.collect()
    assert len(rows) == 30 and {(r.side, r.b.line, r.b.col, r.e.col) for r in rows} == {("L", 2, 17, 17), ("R", 2, 17, 17)}
    assert final_plan(spans).count("FlatMapCoGroupsInArrow") == 1


def test_a_text_is_sent_to_parts_of_many_blocks(spark):
    from hunkweave.operators import joins

    text = F.concat(F.lit("some text of a family that is long enough "), F.md5(F.expr("cast(id div 3 AS string)").cast("binary")), (F.col("id") % 3).cast("string"))
    rows = spark.range(600).select(F.lit("k").alias("k"), "id", text.alias("t"))
    dealt = joins.dealt_to_blocks(rows, ["k"], "id", "t", block=8)
    assert dealt.count() == 600 * 10  # 75 blocks in parts of eight; each text was sent 75 times
    whole = {tuple(r) for r in joins.clone_pairs(rows, ["k"], "id", "t").collect()}
    assert {(s, d) for _, s, d in whole} >= {(3 * k, 3 * k + 1) for k in range(200)}
    assert [tuple(r) for r in joins.clone_pairs(rows, ["k"], "id", "t", block=8).orderBy("src", "dst").collect()] == sorted(whole)
