"""Token ids in wavelet-matrix files, one for each shard of documents in ascending id order.

A file holds, after a magic number and a JSON header, the shard's document ids and lengths and one bit-plane for each
bit of an id, highest first, each with the number of ones before every block of 512 bits.  So it takes as
many bits a token as the largest id has and, without being unpacked, answers access(i), rank(id, i) - how often an
id occurs before a position - and select(id, k) - where its k-th occurrence is.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, tokens
from .common import new_path, size_in_bytes, written

MAGIC = b"WVMX\x01\0\0\0"
BLOCK = 512
#: Bytes of input for each shard.
SHARD_BYTES = 32 << 20


def _planes(ids: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(zeros, packed bits, ones before each block) of each plane; each orders the next by its bit."""
    for b in range(bits - 1, -1, -1):
        bit = (ids >> ids.dtype.type(b) & ids.dtype.type(1)).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(packed).astype(np.uint32), np.arange(0, len(packed), BLOCK // 8)) if len(packed) else np.empty(0, np.uint32)
        before = np.concatenate(([0], np.cumsum(ones))).astype("<u4")
        yield len(ids) - int(before[-1]), packed.tobytes(), before.tobytes()
        ids = np.concatenate((ids[~bit], ids[bit]))


def encode(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file of one shard."""
    bits = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    planes = list(_planes(ids.astype(np.uint16 if bits <= 16 else np.uint32), bits))
    docs = zlib.compress(json.dumps([doc_ids, lengths], separators=(",", ":")).encode(), 1)
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "docs_bytes": len(docs), "bits": bits, "block": BLOCK, "zeros": [p[0] for p in planes]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, docs, *(x for p in planes for x in p[1:])])


class WaveletMatrix:
    def __init__(self, raw: bytes):
        assert raw[: len(MAGIC)] == MAGIC, "not a wavelet-matrix file"
        at = len(MAGIC) + 8
        n = int.from_bytes(raw[len(MAGIC) : at], "little")
        head, at = json.loads(raw[at : at + n]), at + n
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        self.doc_ids, self.lengths = json.loads(zlib.decompress(raw[at : at + head["docs_bytes"]]))
        at += head["docs_bytes"]
        size = -(-self.n // 8)
        blocks = -(-size // (BLOCK // 8)) + 1
        self.planes, self.ones = [], []
        for _ in range(self.bits):
            self.planes.append(np.frombuffer(raw, np.uint8, size, at))
            self.ones.append(np.frombuffer(raw, "<u4", blocks, at + size))
            at += size + 4 * blocks

    def __len__(self) -> int:
        return self.n

    def _rank1(self, p: int, i: int) -> int:
        """Ones of plane p before position i."""
        block = i // BLOCK
        part = self.planes[p][block * BLOCK // 8 : -(-i // 8)]
        ones = int(np.bitwise_count(part).sum())
        if i % 8 and len(part):
            ones -= int(part[-1] >> (i % 8)).bit_count()
        return int(self.ones[p][block]) + ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.bits):
            bit = int(self.planes[p][i // 8]) >> (i % 8) & 1
            ones = self._rank1(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of an id before position i lie below the last plane."""
        if token < 0 or token >> self.bits:
            return 0, 0
        lo = 0
        for p in range(self.bits):
            a, b = self._rank1(p, lo), self._rank1(p, i)
            lo, i = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, i - b)
        return lo, i

    def rank(self, token: int, i: int | None = None) -> int:
        """How often an id occurs before position i, or at all."""
        lo, hi = self._range(token, self.n if i is None else min(max(i, 0), self.n))
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence, from 0."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - p) & 1
            i = self._select(p, one, i - self.zeros[p] if one else i)
        return i

    def _select(self, p: int, one: int, k: int) -> int:
        lo, hi = 0, self.n
        while lo < hi:  # the smallest end with more than k such bits
            mid = (lo + hi) // 2
            ones = self._rank1(p, mid + 1)
            if (ones if one else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the last."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            up[~bit], up[bit] = ids[: self.zeros[p]], ids[self.zeros[p] :] | kind(1 << (self.bits - 1 - p))
            ids = up
        return ids.astype("<u4")


def write(docs: DataFrame, tokenizer: str, end: int = tokens.END, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes a file for each shard to the shared folder; the manifest (shard, path, n_docs, n_tokens).

    Shards are ranges of the id, in ascending order; null ids come first; rows that share an id are in the order of
    their texts' hashes, and many of them may spread over shards.  A null text counts as empty and still has the end id;
    an empty table gives no file; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "wavelet")
    stop = end.to_bytes(4, "little")
    shards = max(4, size_in_bytes(docs, text_col) // shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, doc_ids, lengths, held = TaskContext.get().partitionId(), [], [], []
        for b in batches:
            doc_ids += b.column(0).to_pylist()
            for at in range(0, len(b), 500):
                for ids in tokens.encoder(tokenizer).ids_of(b.column(1).slice(at, 500).to_pylist()):
                    lengths.append(len(ids) // 4 + 1)
                    held += [ids, stop]
            held = [b"".join(held)]
        if doc_ids:
            path = f"{folder}/{shard:08d}-{TaskContext.get().taskAttemptId()}.wvm"
            with files.new_file(path) as out:
                out.write(encode(doc_ids, lengths, np.frombuffer(b"".join(held), "<u4")))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(doc_ids)], "n_tokens": [sum(lengths)]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    ordered = rows.repartitionByRange(shards, "id", "h").sortWithinPartitions("id", "h").select("id", "t")
    return written(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "manifest")


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files.  start: tokens of all documents before it.

    A document with a null id or text has its row like any; a manifest without files gives none.
    """
    # One row a shard: the window holds as many rows as there are files.
    before = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = WaveletMatrix(files.read_file(path))
                ids, at, starts, crcs = m.decode(), 0, [], []
                for n in m.lengths:
                    starts.append(start + at)
                    crcs.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(m.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(m.lengths, pa.int64()), pa.array(crcs, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    shards = max(1, manifest.count())
    return before.select("path", "before").repartition(min(shards, 100_000)).mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")
