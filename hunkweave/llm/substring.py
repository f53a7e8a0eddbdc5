"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A word is removed if a window that covers it also starts in a document with a smaller id.  Hashes of one map
batch go out packed, one row for each bucket of the hash space, after equal ones of the batch were merged: only
the smallest document keeps its entry, the others are known to repeat and carry their removal intervals past the
buckets.  A passage that a third of all documents share is so one entry a batch.  A bucket holds a fixed number of
windows at any input size.  Its repeats return to their documents by a join on the id.

Two different windows count as equal only if their 64-bit hashes collide.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, size_in_bytes, slices

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words whose windows are merged on the map side at once, and bytes of input files for each bucket.
BATCH_WORDS, BUCKET_BYTES, LEAST_BUCKETS = 1_500_000, 6 << 20, 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def window_hashes(words: list[bytes], window: int) -> np.ndarray:
    """The hash of each window; fewer words than that: none."""
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h *= BASE
        h += w[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def intervals(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal word intervals [from, to) that windows at these sorted starts cover, as rows."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    first = np.concatenate(([True], starts[1:] > starts[:-1] + window))
    at = np.flatnonzero(first)
    return np.stack((starts[at], starts[np.append(at[1:], len(starts)) - 1] + window), 1)


def _packed_ids(ids: np.ndarray) -> bytes:
    """Ascending ids: the first, then the gaps, in four bytes each if all fit."""
    gaps = np.diff(ids)
    wide = len(gaps) and int(gaps.max()) >= 1 << 32
    return (b"\1" if wide else b"\0") + ids[:1].astype("<i8").tobytes() + gaps.astype("<u8" if wide else "<u4").tobytes()


def _ids(packed: bytes) -> np.ndarray:
    first, gaps = np.frombuffer(packed, "<i8", 1, 1), np.frombuffer(packed, "<u8" if packed[0] else "<u4", offset=9)
    return np.concatenate((first, first + np.cumsum(gaps.astype(np.int64))))


def _out(bucket: list, h: list, ids: list, doc: list, spans: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(h, pa.binary()), pa.array(ids, pa.binary()), pa.array(doc, pa.int64()), pa.array(spans, pa.binary())], ["bucket", "h", "ids", "doc", "spans"])


def _merge_batch(docs: list[tuple[int, np.ndarray]], n_buckets: int, window: int) -> pa.RecordBatch:
    docs.sort(key=lambda x: x[0])
    h = np.concatenate([x[1] for x in docs])
    sizes = np.array([len(x[1]) for x in docs])
    ids = np.repeat(np.array([x[0] for x in docs], np.int64), sizes)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    new = np.concatenate(([True], hs[1:] != hs[:-1]))
    lowest = np.empty(len(h), np.int64)
    lowest[order] = ids[order][new][np.cumsum(new) - 1]
    rows: tuple[list, list, list, list, list] = ([], [], [], [], [])
    at = 0
    repeats = lowest < ids
    for (doc, own), n in zip(docs, sizes.tolist()):
        if (hit := repeats[at : at + n]).any():
            for column, x in zip(rows, (doc % n_buckets, None, None, doc, intervals(np.flatnonzero(hit), window).astype("<i4").tobytes())):
                column.append(x)
        at += n
    sent = np.sort(order[new])
    h, ids = h[sent], ids[sent]
    bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    h, ids, bucket = h[order], ids[order], bucket[order]
    cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])).tolist()
    for a, b in zip(cuts, cuts[1:]):
        for column, x in zip(rows, (bucket[a], h[a:b].tobytes(), _packed_ids(ids[a:b]), None, None)):
            column.append(x)
    return _out(*rows)


def repeats(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, h binary, spans binary): the repeated windows of each document by hash, or as word intervals."""
    n_buckets = max(LEAST_BUCKETS, size_in_bytes(docs, text_col) // BUCKET_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                h = window_hashes(text.as_py().split(), window)
                if len(h):
                    held.append((doc, h))
                    n += len(h)
                if n >= BATCH_WORDS:
                    yield _merge_batch(held, n_buckets, window)
                    held, n = [], 0
        if held:
            yield _merge_batch(held, n_buckets, window)

    def count(t: pa.Table) -> pa.Table:
        packed = t.filter(pc.is_valid(t.column("h")))
        past = t.filter(pc.is_valid(t.column("doc")))
        out = [pa.table({"doc": past.column("doc"), "h": pa.nulls(len(past), pa.binary()), "spans": past.column("spans")})]
        if len(packed):
            h = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in packed.column("h")])
            ids = np.concatenate([_ids(x.as_py()) for x in packed.column("ids")])
            order = np.lexsort((ids, h))
            h, ids = h[order], ids[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            repeated = ids[np.flatnonzero(new)][np.cumsum(new) - 1] < ids
            h, ids = h[repeated], ids[repeated]
            order = np.argsort(ids, kind="stable")
            h, ids = h[order], ids[order]
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
            out.append(pa.table({"doc": pa.array(ids[cuts[:-1]], pa.int64()), "h": pa.array([h[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), "spans": pa.nulls(len(cuts) - 1, pa.binary())}))
        return pa.concat_tables(out)

    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    sent = texts.mapInArrow(send, "bucket int, h binary, ids binary, doc long, spans binary")
    # As many tasks as buckets, whatever the session's number of shuffle partitions.
    return sent.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(count, "doc long, h binary, spans binary")


def removed_words(words: list[bytes], hits: list[dict] | None, window: int) -> np.ndarray:
    """Which words go."""
    gone = np.zeros(len(words) + 1, np.int64)
    spans = [np.frombuffer(x["spans"], "<i4").reshape(-1, 2) for x in hits or () if x["spans"] is not None]
    hashes = [np.frombuffer(x["h"], np.uint64) for x in hits or () if x["h"] is not None]
    if hashes:
        spans.append(intervals(np.flatnonzero(np.isin(window_hashes(words, window), np.concatenate(hashes))), window))
    for s in spans:
        np.add.at(gone, s[:, 0], 1)
        np.add.at(gone, s[:, 1], -1)
    return np.cumsum(gone[:-1]) > 0


def _with_hits(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The rows with one more column, whose name is returned: their hits."""
    name, own = fresh(docs, "hits"), fresh(docs, "hits_of")
    hits = repeats(docs, window, id_col, text_col).groupBy("doc").agg(F.collect_list(F.struct("h", "spans")).alias(name)).withColumnRenamed("doc", own)
    return docs.join(hits, docs[id_col].cast("long") == F.col(own), "left").drop(own), name


def digests(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row.

    A null text has no words; a row with a null id marks nothing and keeps all its words; rows that share an id
    are not smaller than each other, so they lose the same windows to smaller ids only.  An empty table gives
    none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, sha = [], [], []
            for text, hits in zip(b.column(1), b.column(2)):
                words, hits = (text.as_py() or b"").split(), hits.as_py()
                kept = words
                if hits:
                    kept = [w for w, x in zip(words, removed_words(words, hits, window).tolist()) if not x]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], [id_col, "n_words", "n_removed", "kept_sha256"])

    joined, name = _with_hits(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias(text_col)), window, id_col, text_col)
    return joined.select(id_col, text_col, name).mapInArrow(run, f"{id_col} long, n_words long, n_removed long, kept_sha256 string")


def cut_text(text: bytes, hits: list[dict] | None, window: int) -> bytes:
    """The text without its removed words and the space before each; unchanged if none goes."""
    if not hits:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    gone = removed_words(text.split(), hits, window)
    if not gone.any():
        return text
    out, last = [], 0
    for x, (_, b) in zip(gone.tolist(), at):
        if not x:
            out.append(text[last:b])
        last = b
    return b"".join([*out, text[last:]]).lstrip(b" \t\n\r\x0b\x0c")


def remove(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns, repeated intervals cut from the text.

    Null texts stay null, and a text that is all removed is empty; a row with a null id keeps its text; rows that share an id
    lose the same windows to smaller ids only; an empty table gives none.
    """
    joined, name = _with_hits(docs, window, id_col, text_col)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [None if t is None else cut_text(t.encode(), hits.as_py(), window).decode() for t, hits in zip(b.column(text_col).to_pylist(), b.column(name))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.column(text_col).type) if c == text_col else b.column(c) for c in names], names)

    return joined.select(*names, name).mapInArrow(run, schema)
