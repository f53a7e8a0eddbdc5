"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows.  A piece goes to the window it fits best; when none fits and
no more may be opened, the fullest is filled up with the head of the piece and emitted.  The windows left open at
the end of a partition are the input of the next, much smaller round; the last round has one task, which gets at
most ``FAN_IN`` partitions' windows and cuts what remains into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import written

LENGTH, WINDOWS, FAN_IN, BATCH_BYTES = 2048, 8, 16, 2 << 20
_COLUMNS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

#: A piece: document, ids before it there, its ids (4 bytes each), ids of the whole document.
Piece = tuple[int | None, int, bytes, int]


class Packer:
    def __init__(self, prefix: int, length: int = LENGTH, windows: int = WINDOWS, keep_ids: bool = False):
        self.length, self.windows, self.keep_ids = length, windows, keep_ids
        self.next_id, self.open, self.rows, self.held = prefix, [], [], 0

    def emit(self, pieces: list[Piece]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at, ids if self.keep_ids else None))
            self.held += 100 + len(ids) * self.keep_ids
            at += n
        self.next_id += 1

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        full, at = 4 * self.length, 0
        while len(ids) - at >= full:
            self.emit([(doc, start, ids[at : at + full], total)])
            start, at = start + self.length, at + full
        ids = ids[at:]
        while ids:
            fits = [w for w in self.open if w[0] + len(ids) <= full]
            if fits:
                best = max(fits, key=lambda w: w[0])
                best[1].append((doc, start, ids, total))
                best[0] += len(ids)
                if best[0] == full:
                    self.open.remove(best)
                    self.emit(best[1])
                return
            if len(self.open) < self.windows:
                self.open.append([len(ids), [(doc, start, ids, total)]])
                return
            fullest = max(self.open, key=lambda w: w[0])
            gap = full - fullest[0]
            self.open.remove(fullest)
            self.emit([*fullest[1], (doc, start, ids[:gap], total)])
            start, ids = start + gap // 4, ids[gap:]

    def finish(self) -> None:
        """The last windows as one run of ids, cut to full sequences and then to falling powers of two."""
        pieces = [p for w in self.open for p in w[1]]
        left, self.open = sum(len(p[2]) for p in pieces) // 4, []
        while pieces:
            size = min(self.length, 1 << (left.bit_length() - 1))
            left, room, own = left - size, 4 * size, []
            while room:
                doc, start, ids, total = pieces.pop(0)
                own.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room // 4, ids[room:], total))
                room -= len(own[-1][2])
            self.emit(own)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.held = self.rows, [], 0
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_COLUMNS.values())], list(_COLUMNS))

    def left(self) -> Iterator[pa.RecordBatch]:
        """The open windows' pieces, which have no sequence yet and carry their ids."""
        self.rows = [(doc, start, len(ids) // 4, None, total, None, None, ids) for w in self.open for doc, start, ids, total in w[1]]
        yield self.batch()


def _round(df: DataFrame, number: int, last: bool, read, length: int, windows: int, keep_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(number << 56 | TaskContext.get().partitionId() << 32, length, windows, keep_ids)
        for b in batches:
            for piece in read(b):
                packer.add(*piece)
                if packer.held >= BATCH_BYTES:
                    yield packer.batch()
        if last:
            packer.finish()
        yield packer.batch()
        yield from packer.left()

    return written(df.mapInArrow(run, SCHEMA), "packed")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, windows: int = WINDOWS, end: int = tokens.END, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A null text counts as empty and still has the end id, so every row has a piece; rows that share an id, or have
    none, are packed each on its own; an empty table gives none; other columns are ignored.  ids is null unless
    keep_ids is set.  Each round is written to the shared folder before the next reads it, so that a repeated task
    can't cut its pieces in another way.
    """
    stop = end.to_bytes(4, "little")

    def texts(b: pa.RecordBatch) -> Iterator[Piece]:
        for at in range(0, len(b), 200):
            some = b.slice(at, 200)
            for doc, ids in zip(some.column(0).to_pylist(), tokens.encoder(tokenizer).ids_of(some.column(1).to_pylist())):
                yield doc, 0, ids + stop, len(ids) // 4 + 1

    def pieces(b: pa.RecordBatch) -> Iterator[Piece]:
        for doc, start, ids, total in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
            yield doc, start, ids, total

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    parts = max(1, source.rdd.getNumPartitions())
    done, number = _round(source, 0, parts == 1, texts, length, windows, keep_ids), 0
    out = done.where("sequence_id is not null")
    while parts > 1:
        parts, number = -(-parts // FAN_IN), number + 1
        left = done.where("sequence_id is null").coalesce(parts)
        parts = max(1, left.rdd.getNumPartitions())
        done = _round(left, number, parts == 1, pieces, length, windows, keep_ids)
        out = out.union(done.where("sequence_id is not null"))
    return out
