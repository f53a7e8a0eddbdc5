"""Methods of equal statements are compared as classes (finding 2 of round 3)."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from hunkweave.operators import refactorings
from hunkweave.operators.diff import best_first, similar_pairs


def test_classes_match_as_their_members_do(spark):
    draw = random.Random(3)
    made = lambda side, n: [(case, f"{side}{draw.randrange(10**6)}.C{k}#f()", [draw.choice("ab"), draw.choice("cde"), "x", "y", "z"][: draw.choice((4, 5))]) for case in range(3) for k in range(n)]
    gone, new = (spark.createDataFrame(made(s, n), "case_id long, id string, statements array<string>").localCheckpoint() for s, n in (("o", 25), ("n", 20)))
    none = F.lit(None).cast("string")
    entries = gone.select("case_id", F.lit("DELETE").alias("change_type"), F.col("id").alias("left_path"), none.alias("right_path"), F.concat(F.lit("L"), "case_id", "id").alias("left_blob"), none.alias("right_blob")).union(new.select("case_id", F.lit("ADD"), none, "id", none, F.concat(F.lit("R"), "case_id", "id")))
    contents = gone.select(F.concat(F.lit("L"), "case_id", "id").alias("blob_id"), F.array_join("statements", "\n").alias("content")).union(new.select(F.concat(F.lit("R"), "case_id", "id"), F.array_join("statements", "\n")))
    want = {tuple(r) for r in best_first(similar_pairs(entries, ["case_id"], contents), ["case_id"]).select("case_id", "left_path", "right_path").collect()}
    assert len(want) > 40
    for small in (None, 0):
        assert {tuple(r) for r in refactorings._moved(gone, new, small).collect()} == want


def test_a_part_goes_to_its_own_type_then_to_the_smallest_name(spark):
    row = "case_id long, id string, statements array<string>"
    parts = spark.createDataFrame([(0, f"T{k}#part()", list("abcde")) for k in range(6)], row)
    wholes = spark.createDataFrame([(0, f"T{k}#whole()", list("abcdef"[: 4 + k % 2])) for k in range(4)], row)
    got = {r.part: (r.whole, r.share) for r in refactorings._contained(parts, wholes).collect()}
    assert got == {f"T{k}#part()": (f"T{k if k in (1, 3) else 1}#whole()", 1.0) for k in range(6)}
