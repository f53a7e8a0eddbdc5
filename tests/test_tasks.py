"""Steps with many rows have larger tasks, not ever more (findings 3, 4 and 13 of round 3)."""

from __future__ import annotations

from hunkweave.sources.java import parse_files
from hunkweave.sources.tables import tasks


def test_tasks_grow_once_there_are_many():
    assert [tasks(n, 128) for n in (0, 1, 129, 512 * 128)] == [1, 1, 2, 512]
    assert tasks(200_000, 128) == 512 and tasks(1_800_000, 128) == 1758


def test_files_of_one_task_are_parsed_in_slices(spark, monkeypatch):
    monkeypatch.setattr("hunkweave.sources.java.spread", lambda df, rows: df.coalesce(1))
    files = spark.range(300).selectExpr("id AS case_id", "'R' AS side", "concat('C', id, '.java') AS path", "concat('class C', id, ' { int f; }') AS content")
    found = parse_files(files).where("kind = 'Class'")
    assert found.select("case_id").distinct().count() == found.count() == 300
