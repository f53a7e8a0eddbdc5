"""Toxicity by compression distance.

Two zstandard dictionaries are made: one trained on windows of ordinary texts, and one that continues it with what
toxic texts hold and ordinary ones don't.  A window of a text counts by how many bytes fewer it takes with the
second; a text's score is a calibrated (logistic) function of how many of its windows save how much.

The model is fitted on at most ``TOXIC`` and ``ORDINARY`` labelled texts, taken in the order of a hash of their ids.  Two
thirds of them make the dictionaries, the rest calibrates, so that no text is judged by what was picked from it.  The
texts stay with the workers: the driver gets ``SAMPLES`` short windows of each ordinary one, the counts of pieces that
mark toxic texts, at most ``PIECES`` of them, and the numbers that are calibrated on.  Scoring is a map over all whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, fresh, remove, slices, written

TOXIC, ORDINARY = 2000, 6000
#: Windows are cut twice, by either size, so that a word at the edge of one is inside another.
WINDOWS, BASE_BYTES, TOXIC_BYTES, LEVEL = (28, 40), 110_000, 1000, 3
SAVED = (1, 2, 3, 4, 6)
SAMPLES, PIECES, LEAST_Z, FIT_TASKS = 8, 50_000, 3.5, 24
_WORDS = re.compile(rb"[^\x00-\x60\x7b-\x7f]+")


def windows(text: bytes | None, size: int) -> list[bytes]:
    """Runs of whole words, of ``size`` bytes or a little more."""
    out, own, n = [], [b""], 0
    for w in _WORDS.findall((text or b"").lower()):
        own.append(w)
        n += len(w) + 1
        if n >= size:
            own.append(b"")
            out.append(b" ".join(own))
            own, n = [b""], 0
    if n:
        own.append(b"")
        out.append(b" ".join(own))
    return out


def _segments(text: bytes | None) -> set[bytes]:
    """Beginnings of words and whole words, each with the space before it."""
    out = set()
    for w in set(_WORDS.findall((text or b"").lower())):
        w = b" " + w
        out.update(w[:n] for n in range(5, min(len(w), 12) + 1))
        out.add(w[:24] + b" ")
    return out


def _worth(here: float, there: float, n: int, m: int) -> tuple[float, float]:
    """(z of the difference of shares, weight) of a piece in so many of n toxic and of m ordinary texts."""
    p = (here + there + 1) / (n + m + 2)
    z = (here / n - there / m) / math.sqrt(p * (1 - p) * (1 / n + 1 / m))
    return z, (here / n / (here / n + 4 * there / m)) ** 2 if here else 0.0


def toxic_segments(worth: dict[bytes, float], held: dict[bytes, list[int]], n: int, size: int = TOXIC_BYTES) -> bytes:
    """What marks toxic texts, the most telling last; each next piece is the one that tells most of the texts covered least.

    worth: the weight of each piece; held: which of the n toxic texts have it.
    """
    # Of segments that mark the same texts, the longest.
    same: dict[tuple, bytes] = {}
    for s in worth:
        k = tuple(held[s])
        if k not in same or (len(s), s) > (len(same[k]), same[k]):
            same[k] = s
    pieces = sorted(same.values())
    if not pieces:
        return b""
    flat, starts = np.concatenate([held[s] for s in pieces]), np.cumsum([0, *(len(held[s]) for s in pieces[:-1])])
    gain, weight, out, total = np.array([worth[s] for s in pieces]), np.ones(n), [], 0
    for _ in range(len(pieces)):
        if total >= size:
            break
        at = int((np.add.reduceat(weight[flat], starts) * gain).argmax())
        best, gain[at] = pieces[at], -1.0
        weight[held[best]] *= 0.7
        if not any(best in x for x in out):
            out.append(best)
            total += len(best)
    return b"".join(reversed(out))


class Model:
    """The two dictionaries and the calibration; sent to the workers."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.mean = self.scale = self.weights = None
        self.coders = None

    def __getstate__(self):
        return self.__dict__ | {"coders": None}

    def saved(self, text: bytes | None, size: int) -> np.ndarray:
        """Bytes that each window saves."""
        if self.coders is None:
            raw = zstandard.DICT_TYPE_RAWCONTENT
            self.coders = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=raw)).compress for d in (self.ordinary, self.ordinary + self.toxic)]
        a, b = self.coders
        return np.array([len(a(w)) - len(b(w)) for w in windows(text, size)] or [0], float)

    def features(self, text: bytes | None) -> list[float]:
        """Of each size of windows: the most that one saves, and how many save how much.  No text: no window saves."""
        out = []
        for size in WINDOWS:
            d = self.saved(text, size)
            top, n = np.sort(d)[::-1], len(d)
            over = [int((d >= s).sum()) for s in SAVED]
            out += [top[0], top[:3].mean(), d.mean(), *map(math.log1p, over), *(k / n for k in over)]
        return [*out, math.log(n)]

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1.0) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.column_stack((np.ones(len(x)), (x - self.mean) / self.scale))
        w, pull = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
        pull[0, 0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ w)
        self.weights = w

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = (np.array([self.features(t) for t in texts]) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _base(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(BASE_BYTES, samples).as_bytes()[-BASE_BYTES:]
    except zstandard.ZstdError:  # too few samples to train on; they are the dictionary
        return b"".join(samples)[-BASE_BYTES:].ljust(16)


def _mapped(texts: DataFrame, schema: str, each) -> DataFrame:
    """each(rows) makes new rows of the rows (number, toxic, t) of a partition."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = each(row for b in slices(batches) for row in zip(*(c.to_pylist() for c in b.columns)))
        while rows := list(islice(found, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return texts.select("number", "toxic", "t").mapInArrow(run, schema)


def _piece_counts(rows) -> Iterator[tuple[bytes, int, int]]:
    counts: dict[bytes, int] = {}  # of ordinary texts, and of toxic ones in the upper half
    for _, toxic, t in rows:
        for s in _segments(t):
            counts[s] = counts.get(s, 0) + (1 << 32 if toxic else 1)
        if len(counts) > 100_000:
            yield from ((s, n >> 32, n & 0xFFFFFFFF) for s, n in counts.items())
            counts.clear()
    yield from ((s, n >> 32, n & 0xFFFFFFFF) for s, n in counts.items())


def train(texts: DataFrame) -> Model:
    """Of rows (number, calibrates, toxic boolean, t binary).  Without both kinds of texts the model scores everything zero."""
    made, calibrates = texts.where("NOT calibrates"), texts.where("calibrates")
    size = {(r.calibrates, r.toxic): r["count"] for r in texts.groupBy("calibrates", "toxic").count().collect()}
    if len(size) < 4 or not texts.count():
        if len({k for _, k in size}) < 2:
            return Model(b"", b"")
        made = calibrates = texts  # a handful of texts, none of a kind to spare
        size = {(c, k): sum(n for (_, x), n in size.items() if x == k) for c in (False, True) for _, k in size}
    n, m = size[False, True], size[False, False]

    def spread(rows) -> Iterator[tuple[int, bytes]]:
        for number, _, t in rows:
            w = windows(t, WINDOWS[-1])
            for x in w[:: max(1, len(w) // SAMPLES)][:SAMPLES]:
                yield number, x

    rows = _mapped(made.where("NOT toxic"), "number long, w binary", spread).collect()
    base = _base([bytes(r.w) for r in sorted(rows, key=lambda r: (r.number, bytes(r.w)))])
    counts = _mapped(made, "s binary, here long, there long", _piece_counts).groupBy("s").agg(F.sum("here").alias("here"), F.sum("there").alias("there"))
    p = (F.col("here") + F.col("there") + 1) / (n + m + 2)
    z = (F.col("here") / n - F.col("there") / m) / F.sqrt(p * (1 - p) * (1 / n + 1 / m))
    found = counts.where((F.col("here") >= 4) & (z >= LEAST_Z)).orderBy(z.desc(), "s").limit(PIECES).collect()
    pieces = sorted(bytes(r.s) for r in found)
    worth = {bytes(r.s): _worth(r.here, r.there, n, m)[1] for r in found}
    at = {s: i for i, s in enumerate(pieces)}

    def holds(rows) -> Iterator[tuple[int, list[int]]]:
        for number, _, t in rows:
            yield number, sorted(at[s] for s in _segments(t) if s in at)

    held: dict[bytes, list[int]] = {s: [] for s in pieces}
    for i, r in enumerate(sorted(_mapped(made.where("toxic"), "number long, held array<int>", holds).collect(), key=lambda r: (r.number, r.held))):
        for k in r.held:
            held[pieces[k]].append(i)
    model = Model(base, toxic_segments(worth, held, n) or b" ")

    def numbers(rows) -> Iterator[tuple[int, bool, list[float]]]:
        for number, toxic, t in rows:
            yield number, toxic, model.features(t)

    rows = sorted(_mapped(calibrates, "number long, toxic boolean, x array<double>", numbers).collect(), key=lambda r: (r.number, r.toxic, r.x))
    model.calibrate(np.array([r.x for r in rows]), np.array([float(r.toxic) for r in rows]))
    return model


def fit(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, toxic: int = TOXIC, ordinary: int = ORDINARY, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on labelled rows outside the held-out fold: at most so many of each kind.

    Labels other than 0 and 1, and ids labelled both ways, are left out; of documents that share an id the text with the
    least hash is taken.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_fold(F.col(id_col)) != held_out_fold)).groupBy(F.col(id_col).cast("long").alias("number"))
    known = known.agg(F.min("toxic").alias("least"), F.max("toxic").alias("toxic")).where("least = toxic").select("number", (F.col("toxic") == 1).alias("toxic"))
    order = F.xxhash64("number")
    some = [known.where(k).orderBy(order, "number").limit(n) for k, n in (("toxic", toxic), ("NOT toxic", ordinary))]
    texts = docs.select(F.col(id_col).cast("long").alias("number"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("t"))
    # The side that is sent has at most toxic + ordinary rows.
    rows = texts.join(F.broadcast(some[0].union(some[1])), "number").repartition(FIT_TASKS, "number").groupBy("number", "toxic").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    rows = written(rows.select("number", "toxic", "t", (F.pmod(F.xxhash64("number", F.lit(1)), F.lit(3)) == 0).alias("calibrates")), "labelled")
    model = train(rows)
    remove(docs.sparkSession, rows)
    return model


def scored(docs: DataFrame, model: Model, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """The rows with all their columns and the score of the whole text."""
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c != score_col]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [None if t is None else t if isinstance(t, bytes) else t.encode() for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(model.score(texts) if texts else [], pa.float64())], [*names, score_col])

    return docs.select(*names).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    A null text counts as empty and is scored like any; a null id is in no fold; repeated rows are scored each; labels
    other than 0 and 1, and of ids that no document has, are left out; without labels of both kinds every score is 0.
    """
    model = fit(docs, labels, held_out_fold, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(crc_fold(F.col(id_col)) == held_out_fold, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return scored(rows, model).select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, with their own columns, whatever these are called.

    Null and empty texts are scored like any; repeated rows stay or go together; an empty table gives none.
    """
    score = fresh(docs, "score")
    return scored(docs, model, score, text_col).where(F.col(score) < threshold).select(*docs.columns)
