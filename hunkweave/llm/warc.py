"""WARC archives: pages written as request, response or revisit, and metadata records, and put together again.

A shard is one gzip member a record, so a reader starts at any record.  The records of a capture name its response
(or revisit) in WARC-Concurrent-To; assembly joins them by that identifier into one nested row.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import new_path, written

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A shard is closed once it has this many compressed bytes.
SHARD_BYTES = 32 << 20
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:hunkweave:warc")
RECORD = "shard string, seq long, type string, record_id string, concurrent_to string, refers_to string, page_id long, target_uri string, date string, digest string, payload_bytes long, headers string, payload binary"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps(parts))}>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def _clean(value: str | None) -> str:
    """A header value in one line."""
    return " ".join((value or "").split())


def capture(page_id: int | None, url: str | None, payload: bytes, revisit: bool, response_id: str | None, own_id: str, date: str) -> bytes:
    """The records of one capture: response or revisit, request, metadata."""
    uri, digest = _clean(url), sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    main = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own_id), *common, ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        main += [("WARC-Profile", REVISIT), ("WARC-Refers-To", response_id or "")]
    out = record([*main, ("Content-Type", "application/http; msgtype=response")], http if revisit else http + payload)
    path = "/" + uri.partition("://")[2].partition("/")[2]
    host = uri.partition("://")[2].partition("/")[0]
    out += record([("WARC-Type", "request"), ("WARC-Record-ID", record_id(own_id, "request")), *common, ("WARC-Concurrent-To", own_id), ("Content-Type", "application/http; msgtype=request")], f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    about = json.dumps({"page_id": page_id}).encode()
    return out + record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(own_id, "metadata")), *common, ("WARC-Concurrent-To", own_id), ("Content-Type", "application/json")], about)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive of gzip members, one in memory at a time.

    A member may hold several records, and a record several members.  A block that isn't as long as its Content-Length says, an
    archive that ends inside a record or a member, and what isn't a record at all are a ValueError.
    """
    z, rest, held = None, b"", bytearray()

    def more() -> bool:
        """Whether there was more to read; it is in ``held``."""
        nonlocal z, rest
        chunk = rest or stream.read(1 << 20)
        rest = b""
        if not chunk:
            if z is not None:
                raise ValueError("the archive ends inside a gzip member")
            return False
        z = z or zlib.decompressobj(31)
        held.extend(z.decompress(chunk))
        if z.eof:
            z, rest = None, z.unused_data
        return True

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held:
                    raise ValueError("the archive ends inside a record")
                return
        lines = held[:at].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = at + 4
        end = begin + int(fields["Content-Length"])
        while len(held) < end + 4 and more():
            pass
        if held[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the block of {fields.get('WARC-Record-ID')} isn't as long as its Content-Length")
        block = bytes(held[begin:end])
        del held[: end + 4]
        yield fields, block


def _page_id(fields: dict[str, str], block: bytes) -> int | None:
    """The page that a metadata record of ours names; others name none."""
    try:
        about = json.loads(block) if "json" in fields.get("Content-Type", "") else None
    except ValueError:
        return None
    page = about.get("page_id") if isinstance(about, dict) else None
    return page if isinstance(page, int) else None


def write(pages: DataFrame, least: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives to the shared folder; the manifest (path, n_records).

    The payload is the html in UTF-8, a null one empty.  Of pages with equal payloads of ``least`` bytes or more the
    one with the largest id is the response, the rest revisit it; rows that share that id are all responses; smaller
    payloads are all responses.  A null id counts as the smallest.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    # Only ids and digests are compared; payloads meet their response's id by a join that may be split.
    firsts = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("x")).select("digest", F.col("x.page_id").alias("first"), F.col("x.url").alias("first_url"))
    rows = rows.join(firsts, "digest", "left").withColumn("revisit", F.coalesce((F.length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, total, size, held = TaskContext.get(), 0, 0, 0, []

        def close():
            nonlocal n, total, size, held
            path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{n:05d}.warc.gz"
            with files.new_file(path) as out:
                for x in held:
                    out.write(x)
            row = pa.RecordBatch.from_pydict({"path": [path], "n_records": [total]})
            n, total, size, held = n + 1, 0, 0, []
            return row

        for b in batches:
            for page_id, url, payload, digest, first, first_url, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first", "first_url", "revisit"))):
                # Only rows that are equal in all share an id.
                held.append(capture(page_id, url, payload, revisit, record_id(first, digest, first_url), record_id(page_id, digest, url), date))
                total, size = total + 3, size + len(held[-1])
                if size >= SHARD_BYTES:
                    yield close()
        if held:
            yield close()

    return written(rows.select("page_id", "url", "payload", "digest", "first", "first_url", "revisit").mapInArrow(run, "path string, n_records long"), "manifest")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that a manifest lists, in RECORD's columns; an empty manifest gives none.

    payload_bytes and digest are those of the payload that was read, null for a revisit, which has none.  A payload that differs from
    its record's digest ends the job, a damaged archive too.  page_id is null where metadata names no page, as in archives of others.  payloads: False leaves the payloads themselves out (null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.int64() if x.endswith("long") else pa.binary() if x.endswith("binary") else pa.string() for x in RECORD.split(", ")]
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with files.open_file(path) as stream:
                    for seq, (f, block) in enumerate(records(stream)):
                        kind, page, headers, payload, digest, n = f["WARC-Type"], None, None, block, None, None
                        if kind in ("response", "revisit", "request"):
                            head, _, payload = block.partition(b"\r\n\r\n")
                            headers = head.decode()
                        elif kind == "metadata":
                            page = _page_id(f, block)
                        if kind == "response":
                            digest, n = sha1_base32(payload), len(payload)
                            told = f.get("WARC-Payload-Digest", "")  # other digests than bare SHA-1 aren't checked
                            if told.startswith("sha1:") and len(told) == 37 and told != f"sha1:{digest}":
                                raise ValueError(f"{path}: the payload of {f['WARC-Record-ID']} is damaged")
                        size += len(payload)
                        rows.append((path, seq, kind, f["WARC-Record-ID"], f.get("WARC-Concurrent-To"), f.get("WARC-Refers-To"), page, f.get("WARC-Target-URI"), f.get("WARC-Date"), digest, n, headers, payload if payloads else None))
                        if size >= 8 << 20 or len(rows) >= 5_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return manifest.select("path").repartition(max(1, min(manifest.count(), 100_000))).mapInArrow(run, RECORD)


def _counted(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """The rows with ``k``, the how manieth of its type and id each is, by place; only those whose id occurs again are ordered."""
    if again is None:
        return rows.withColumn("k", F.lit(1))
    place = Window.partitionBy("type", "id").orderBy("shard", "seq")
    twice = rows.join(again.hint("merge"), ["type", "id"], "left_semi").withColumn("k", F.row_number().over(place))
    return rows.join(again.hint("merge"), ["type", "id"], "left_anti").withColumn("k", F.lit(1)).unionByName(twice)


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit with the request and metadata records that are concurrent to it.

    Records meet by the concurrent-to identifier, wherever in the archives they stand.  Captures whose request or metadata is
    missing keep null there, and records concurrent to no capture are left out.  Where archives hold an identifier again, as repeated
    rows of the pages make them, whose records are equal, the k-th request and metadata by place go to the k-th capture.
    """
    is_main = F.col("type").isin("response", "revisit")
    rows = recs.withColumn("id", F.when(is_main, F.col("record_id")).otherwise(F.col("concurrent_to"))).where("id IS NOT NULL")
    again = written(rows.groupBy("type", "id").count().where("count > 1").drop("count"), "again")
    again = None if again.isEmpty() else again
    own = F.struct("type", "record_id", "refers_to", "target_uri", "date", "digest", "payload_bytes", "headers", "payload").alias("capture")
    out = _counted(rows.where(is_main), again).select("id", "k", own)
    for kind in ("request", "metadata"):
        side = _counted(rows.where(F.col("type") == kind), again)
        out = out.join(side.select("id", "k", F.struct("record_id", "page_id", "headers", "date").alias(kind)).hint("merge"), ["id", "k"], "left")
    return out.select("capture", "request", "metadata")


def round_trip(pages: DataFrame, least: int = 0, **columns: str) -> DataFrame:
    """Writes the archives and reads them once: page_id, payload_bytes, payload_digest, record_type, refers_to of every page.

    Lengths and digests are of the payloads that were read; a revisit's are those of the response that it refers to by record id.
    """
    recs = written(read(write(pages, least, **columns), payloads=False), "records")
    flat = assemble(recs).select(F.col("metadata.page_id").alias("page_id"), "capture.payload_bytes", F.col("capture.digest").alias("payload_digest"), F.col("capture.type").alias("record_type"), F.col("capture.record_id").alias("rid"), F.col("capture.refers_to").alias("target"))
    flat = written(flat, "captures")
    responses = flat.where("record_type = 'response'")
    targets = responses.groupBy(F.col("rid").alias("target")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    revisits = flat.where("record_type = 'revisit'").select("page_id", "record_type", "target").join(targets.hint("merge"), "target", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return revisits.select(*names, "refers_to").union(responses.select(*names, F.lit(None).cast("long")))
