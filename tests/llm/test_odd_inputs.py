"""Archives of others and damaged ones, argument names and nested schemas, vectors beyond integers, repeated ids."""

from __future__ import annotations

import gzip
import io

import pytest
from pyspark.sql import functions as F

from hunkweave.llm import balltree, files, simhash, toolcalls, warc
from hunkweave.llm.common import new_path


def plain_record(kind, block, rid, extra=""):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_members_of_several_records():
    a, b, c = (plain_record("resource", x, f"r{i}") for i, x in enumerate((b"one", b"two \r\n\r\n two", b"")))
    for archive in (gzip.compress(a + b + c), gzip.compress(a) + gzip.compress(b + c), gzip.compress((a + b)[:70]) + gzip.compress((a + b)[70:] + c)):
        assert [block for _, block in warc.records(io.BytesIO(archive))] == [b"one", b"two \r\n\r\n two", b""]
    assert list(warc.records(io.BytesIO(b""))) == []


@pytest.mark.parametrize("archive", [
    gzip.compress(plain_record("resource", b"x" * 26, "r").replace(b"Content-Length: 26", b"Content-Length: 99")),
    gzip.compress(plain_record("resource", b"x" * 26, "r").replace(b"Content-Length: 26", b"Content-Length: 9")),
    gzip.compress(plain_record("resource", b"x" * 26, "r"))[:-9],
    gzip.compress(plain_record("resource", b"x" * 26, "r") + b"WARC/1.1\r\n"),
    gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"),
])
def test_damaged_archives_are_errors(archive):
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(archive)))


def test_archives_of_others_are_read(spark):
    http = b"HTTP/1.1 200 OK\r\n\r\n<p>hi</p>"
    members = plain_record("warcinfo", b"software: other", "i") + plain_record("response", http, "a", "WARC-Payload-Digest: sha256:abc\r\n") + plain_record("metadata", b"via: nobody", "m", "WARC-Concurrent-To: <a>\r\nContent-Type: application/warc-fields\r\n") + plain_record("metadata", b"[1", "n", "WARC-Concurrent-To: <b>\r\nContent-Type: application/json\r\n")
    at = new_path(spark, "others") + "/x.warc.gz"
    with files.new_file(at) as out:
        out.write(gzip.compress(members))
    recs = warc.read(spark.createDataFrame([(at,)], "path string"))
    assert [(r.type, r.page_id) for r in recs.orderBy("seq").collect()] == [("warcinfo", None), ("response", None), ("metadata", None), ("metadata", None)]
    got = warc.assemble(recs).collect()
    assert len(got) == 1 and bytes(got[0].capture.payload) == b"<p>hi</p>" and got[0].metadata.record_id == "<m>" and got[0].request is None


def test_arguments_of_any_name_and_shape(spark):
    schemas = {
        "t": {"a.b": ("integer", True), "it's": ("string", False), 'q"?': ("boolean", False)},
        "n": {"kind": {"type": "string", "required": True, "enum": ["red", "blé"]}, "list": {"type": "array", "items": {"type": "object", "fields": {"x": ("number", True)}}}, "free": ("object", False)},
    }
    cases = [
        ("t", '{"a.b":1}', True), ("t", '{"a":{"b":1}}', False), ("t", '{"a.b":"1"}', False), ("t", '{"a.b":1,"it\'s":"x","q\\"?":true}', True), ("t", '{"a.b":1,"it\'s":2}', False), ("t", '{"a.b":null}', False), ("t", '{"a.b":1,"c":2}', False),
        ("n", '{"kind":"red"}', True), ("n", '{"kind":"blé"}', True), ("n", '{"kind":"green"}', False), ("n", '{"kind":"red","list":[{"x":1},{"x":2.5}]}', True), ("n", '{"kind":"red","list":[{"x":1},{}]}', False), ("n", '{"kind":"red","list":[{"x":1,"y":2}]}', False),
        ("n", '{"kind":"red","list":[]}', True), ("n", '{"kind":"red","list":{}}', False), ("n", '{"kind":"red","list":[null]}', False), ("n", '{"kind":"red","free":{"any":[1]}}', True), ("n", "[]", False), ("n", "no json", False), ("n", None, False), ("other", "{}", False), (None, "{}", False),
    ]
    rows = spark.createDataFrame(cases, "name string, args string, want boolean")
    bad = rows.withColumn("got", toolcalls.valid_arguments(F.col("name"), F.col("args"), schemas)).where("got <> want OR got IS NULL").collect()
    assert bad == []


def test_vectors_whose_scores_fit_no_long_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [1e17, 1.0]), (20, [1e30, 0.0]), (40, [-2.0, 1.0]), (60, [])]
    got = {(r.query_id, r.vec_id, r.score) for r in balltree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(0, 1, 5 * 4096), (0, 40, 0), (40, 0, 0), (40, 1, -5 * 4096)}


def test_repeated_ids_give_the_same_groups_however_rows_are_dealt(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(1, one), (2, one + " end"), (2, two), (3, two + " end"), (4, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(tuple, simhash.near_copies(df).collect())) for df in (docs.coalesce(1), docs.repartition(3, "text"), docs.orderBy(F.desc("text")).coalesce(1))]
    assert got[0] == got[1] == got[2]
