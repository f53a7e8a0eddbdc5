"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hunkweave.llm import balltree, decontaminate, packing, pst, queries, simhash, substring, toolcalls, tokens, toxicity, warc, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} x{i * 7 % 1013}" for i in range(6000))
PROSE = [" ".join(f"{a}{(i * 31 + k * 17) % 89}" for k, a in enumerate("the of and in to is it on by at as be or we he an do if my up".split() * 3)) for i in range(6)]
TEXTS = [
    (0, PROSE[0]), (1, PROSE[0].upper()), (2, PROSE[0] + " more"), (3, None), (4, ""), (5, " \n\t"), (6, "One"), (7, "one"), (8, LONG), (9, PROSE[1] + "\n" + PROSE[2]),
    (10, "Été ßtraße 中文 😀 don't.\nnext  line"), (10, "Été ßtraße 中文 😀 don't.\nnext  line"), (11, PROSE[2] + " and its own end"), (None, PROSE[3]), (12, "a b c d e f g h i j k l m n"), (13, PROSE[4]),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in TEXTS]
    # Columns whose names the operators use inside.
    names = ("h", "fp", "t", "key", "score", "spans", "w", "n", "hs", "id", "batch", "hits", "hits_of", "own_id", "component_id", "number", "toxic")
    out = spark.createDataFrame(rows, SCHEMA)
    for c in names:
        out = out.withColumn(c, F.lit("clash"))
    return out


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(t):
    return (t or "").encode().lower().split()


def test_simhash_against_brute_force(docs, none):
    def mark(t):
        w = words(t)
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [(i, mark(t)) for i, t in TEXTS]
    label = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    low = {k: min((i for (i, _), x in zip(fps, label) if x == k and i is not None), default=None) for k in label}
    want = Counter((i, f"{f:016x}", low[k]) for (i, f), k in zip(fps, label))
    got = simhash.near_dedup(docs)
    assert Counter(map(tuple, got.collect())) == want
    assert simhash.near_dedup(none).count() == 0


def test_trie_join_finds_every_link_of_dense_groups(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, k, replace=False).astype(np.uint64)) for b in base for k in (1, 2, 3, 4, 5, 6)], np.uint64)
    fps = np.unique(np.concatenate((base, near, base[:1] ^ np.arange(64, dtype=np.uint64))))
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = list(range(len(fps)))
    apart = np.bitwise_count(fps[:, None] ^ fps[None])
    for _ in range(30):
        want = [min(want[j] for j in np.nonzero(apart[i] <= 4)[0]) for i in range(len(fps))]
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for leaves in (16_384, 4):  # the small bound cuts heavy nodes into blocks
        found = simhash.links(rows, 4, leaves).collect()
        got = list(range(len(fps)))
        for _ in range(30):
            for x in found:
                a, b = at[x.a], at[x.b]
                got[a] = got[b] = min(got[a], got[b])
        assert all(apart[at[x.a], at[x.b]] <= 4 for x in found)
        assert len({(a, b) for a, b in zip(got, want)}) == len(set(want)) == len(set(got))


def test_near_copies_are_verified(docs, none, spark):
    assert simhash.near_copies(none).count() == 0
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[3] == got[4] == got[5] == 3 and got[6] == got[7] == 6 and got[8] == 8 and got[9] == 9 and None not in got
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted((i for i in kept if i is not None)) == [0, 3, 6, 8, 9, 10, 10, 11, 12, 13] and None in kept


def test_substring_against_brute_force(docs, none):
    starts = {}
    for i, t in TEXTS:
        w = (t or "").encode().split()
        if i is not None:
            for k in range(len(w) - 12):
                starts.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = Counter()
    for i, t in TEXTS:
        w = (t or "").encode().split()
        gone = {k + j for k in range(len(w) - 12) for j in range(13) if i is not None and min(starts[tuple(w[k : k + 13])]) < i}
        kept = [x for k, x in enumerate(w) if k not in gone]
        want[(i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    assert Counter(map(tuple, substring.digests(docs).collect())) == want
    assert substring.digests(none).count() == 0
    cut = {r.doc_id: r.text for r in substring.remove(docs, window=20).collect()}
    assert cut[11] == "and its own end" and cut[9] == PROSE[1] + "\n" + PROSE[2] and cut[3] is None and cut[0] == PROSE[0] and cut[2] == "more"
    assert substring.remove(docs).columns == docs.columns


def test_suffix_tree_base_score_and_total_probability(docs, none):
    rows = {}
    for r in pst.score_documents(docs).collect():
        rows.setdefault(r.doc_id, r)
    train = [words(t) + [b"\n"] for i, t in TEXTS if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    total, distinct = sum(c.values()), len(c)
    for i, t in TEXTS:
        toks, r = words(t) + [b"\n"], rows[i]
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in toks)
        assert r.n_tokens == len(toks) and r.n_known == sum(w in c for w in toks) and r.train_tokens == total
        assert r.base_score == pytest.approx(base) and r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 1)
    assert pst.score_documents(none).count() == 0


def test_suffix_tree_next_tokens_sum_to_one(spark):
    texts = spark.createDataFrame([(i, False, t) for i, t in enumerate([b"a b a c a b", b"b a b a d", b"c c a b", b"x p q r s t y", b"z p q r s t w"] * 4)], "doc_id long, held_out boolean, t binary")
    model, table, _ = pst.fit(texts)
    everything = [bytes(r.word) for r in table.collect()]
    assert len(everything) == len(model.words) and len(model.levels) >= 2
    for before in ([], [b"a"], [b"b", b"a"], [b"c", b"c"], [b"z", b"a"], [b"z", b"p", b"q"]):
        ids = np.concatenate(([model.start], model.ids(before)))
        p = 0.0
        for w in range(len(everything)):
            run = np.append(ids, w)
            at = np.array([len(run) - 1])
            p += 10 ** model.logp(model.contexts(run, at), run[at])[0]
        unknown = np.append(ids, -1)
        at = np.array([len(unknown) - 1])
        p += 10 ** model.logp(model.contexts(unknown, at), unknown[at])[0] * 0.5 / model.scale
        assert p == pytest.approx(1)


def test_suffix_tree_goes_as_deep_as_contexts_tell_more(spark):
    # At each word of a run the longer context narrows what may follow: a number's digits, then one word for each number.
    rows = [f"{' '.join('ab'[int(x)] for x in f'{n:04b}')} end{n}" for n in range(16)] * 6
    texts = spark.createDataFrame([(i, i % 7 == 0, t.encode()) for i, t in enumerate(rows)], "doc_id long, held_out boolean, t binary")
    model, words, numbered = pst.fit(texts)
    assert len(model.levels) >= 4 and all(x["kept"].any() for x in model.levels[:4])
    got = {r.doc_id: r for r in pst.scores(numbered, model, words, 4).collect()}
    assert len(got) == len(rows) and all(r.score > r.base_score + 1 for r in got.values())


def library(name):
    """The library as it comes."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cut_texts_have_the_librarys_ids(name):
    import random

    random.seed(3)
    plain, own = library(name), tokens.Encoder(queries.tokenizer_path(name))
    bits = ["word", " thing,", " Étre", "ß.", "a", "'s", " ", "  ", "\n", "\n\n", "\t", " ", "é", "é", "́", "123", "<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", "!", ",", ".", "İ,", "é,", "÷.", "×,", "Ñ.", "ª.", "\x85", "\u200b", "--", "\x1c", "　", "中", "😀", "ΑΣ", "'", "\r", "ſ", "İ"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 14))) for _ in range(3000)] + [t for _, t in TEXTS if t]
    for t, ids in zip(texts, own.ids_of(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
    assert own.ids_of([None, ""]) == [b"", b""]


def test_packing_covers_each_id_once_without_padding(docs, none, spark):
    plain = library("byte_bpe_50k.json")
    extra = [(20, "before <|endoftext|> after"), (21, " ".join(f"long{i}" for i in range(30_000)))]
    some = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in extra], SCHEMA), allowMissingColumns=True)
    want = Counter((i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in [*TEXTS, *extra])
    for parts in (1, 5):
        got = packing.pack(some.repartition(parts), queries.tokenizer_path("byte_bpe_50k.json"), length=64, windows=3, keep_ids=True).collect()
        pieces, sequences = {}, {}
        for r in got:
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
            pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for (doc, total), rows in pieces.items():
            whole = [k for k in want if k[0] == doc and len(k[1]) == total]
            assert len(whole) == 1  # here no two texts of an id have as many tokens
            covered = Counter()
            for r in rows:
                assert np.frombuffer(r.ids, "<u4").tolist() == list(whole[0][1][r.start : r.start + r.length])
                covered.update(range(r.start, r.start + r.length))
            assert covered == Counter(dict.fromkeys(range(total), want[whole[0]]))
        assert set(pieces) == {(doc, len(ids)) for doc, ids in want}
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 64 and at & (at - 1) == 0
    assert packing.pack(none, queries.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_wavelet_files(docs, none):
    plain = library("word_bpe_49k.json")
    got = wavelet.read(wavelet.write(docs, queries.tokenizer_path("word_bpe_49k.json"), shard_bytes=1)).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = [plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t in TEXTS if i == r.doc_id][0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    assert wavelet.read(wavelet.write(none, queries.tokenizer_path("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 512, 513, 3000])
def test_wavelet_rank_select_access(n):
    ids = np.random.default_rng(n).integers(0, 37, n).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.encode([1], [n], ids))
    assert m.decode().tolist() == ids.tolist() and len(m) == n
    for i in range(0, n, 61):
        assert m.access(i) == ids[i]
    for token in (0, 5, 36, 99):
        where = np.flatnonzero(ids == token)
        assert m.rank(token) == len(where) and m.rank(token, n // 2) == (where < n // 2).sum()
        for k in range(0, len(where), 9):
            assert m.select(token, k) == where[k]
        with pytest.raises(IndexError):
            m.select(token, len(where))


def test_warc_round_trip(spark):
    rows = [(1, "http://a/x", "same"), (2, "http://a/y", "same"), (3, "bad\r\nurl: x", None), (4, None, ""), (5, "u", "é\r\n\r\n" * 9), (None, "n", "same"), (6, "http://b", "only"), (6, "http://b", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first", F.lit(1))
    b32 = lambda t: warc.sha1_base32((t or "").encode())
    got = Counter(map(tuple, warc.round_trip(pages).collect()))
    want = Counter([(1, 4, b32("same"), "revisit", 2), (2, 4, b32("same"), "response", None), (3, 0, b32(""), "revisit", 4), (4, 0, b32(""), "response", None), (5, 54, b32("é\r\n\r\n" * 9), "response", None), (None, 4, b32("same"), "revisit", 2), (6, 4, b32("only"), "response", None), (6, 4, b32("only"), "response", None)])
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    whole = {r.metadata.page_id: r for r in warc.assemble(warc.read(warc.write(pages))).where("metadata.page_id IN (2, 5)").collect()}
    assert bytes(whole[5].capture.payload).decode() == "é\r\n\r\n" * 9 and whole[2].request.headers.startswith("GET /y HTTP/1.1\r\nHost: a")
    assert {r[3] for r in warc.round_trip(pages, least=5).collect()} == {"response"}
    # Records find each other wherever they stand: here every record is moved, and one kind to another file.
    recs = warc.read(warc.write(pages))
    moved = recs.withColumn("shard", F.when(F.col("type") == "metadata", "elsewhere").otherwise(F.col("shard"))).withColumn("seq", F.xxhash64("record_id") % 1000)
    plain = lambda df: Counter((r.capture.type, r.capture.record_id, r.request.record_id, r.metadata.page_id) for r in df.collect())
    assert plain(warc.assemble(moved)) == plain(warc.assemble(recs)) and None not in {k[2] for k in plain(warc.assemble(recs))}
    assert [r.metadata for r in warc.assemble(recs.where("type <> 'metadata'")).collect()] == [None] * 8


def test_damaged_payloads_are_told(spark, tmp_path):
    whole = warc.capture(1, "u", b"payload", False, None, "<urn:x>", "2024-01-01T00:00:00Z")
    record = b"".join(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:y>"), ("WARC-Payload-Digest", "sha1:" + warc.sha1_base32(b"other"))], b"HTTP/1.1 200 OK\r\n\r\npayload") for _ in range(1))
    for name, raw, ok in (("a", whole, True), ("b", record, False)):
        (tmp_path / name).write_bytes(raw)
        recs = warc.read(spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "path string"))
        if ok:
            assert recs.count() == 3
        else:
            with pytest.raises(Exception, match="damaged"):
                recs.collect()


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 3) / 64]) for i in range(90)] + [(20, None), (100, [1.0, float("nan"), 0.0]), (None, [1.0, 1.0, 1.0]), (101, [1.0, 2.0]), (120, [2.0, 1.0]), (140, []), (160, [1.0, None, 2.0]), (7, [0.5, 0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in good:
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)))[:20]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    for shard, block in ((4096, 4096), (16, 2)):
        assert {tuple(x) for x in balltree.top_k(table, shard=shard, block=block).collect()} == want
    assert balltree.top_k(table.limit(0)).count() == 0


def test_toxicity(docs, none, spark):
    import random

    random.seed(2)
    clean = ["".join(random.choice(["ba", "ko", "ri", "mu", "te", "so", "la"]) for _ in range(3)) for _ in range(400)]
    bad = "vilescum rottenfool trashmouth".split()
    rows, marks = [], []
    for i in range(400):
        w = random.choices(clean, k=random.randint(30, 120))
        toxic = i % 5 == 0
        for _ in range(5 if toxic else 0):
            w.insert(random.randrange(len(w)), random.choice(bad))
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(toxic)))
    some = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "a b")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([*marks, (5, 1, None), (None, 0, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(some, labels).collect()}
    held = [i for i, _, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 403 and got[1000].score == got[1001].score and not got[None].held_out
    assert sum(got[i].predicted == marks[i][2] for i in held) >= 0.97 * len(held) and all(got[i].held_out for i in held)
    model = toxicity.fit(some, labels)
    kept = toxicity.keep_clean(some, model)
    assert kept.columns == some.columns and kept.count() == sum(r.predicted == 0 for r in got.values())
    assert {r.score for r in toxicity.classify(some, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(some.limit(0), labels).count() == 0


def similarity(a, b):
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in (a, b))
    both = sum((x & y).values())
    return both / (x.total() + y.total() - both) if both else 0.0


def test_decontamination_against_brute_force(docs, none, spark):
    item = PROSE[5].split()
    changed = item[:20] + ["other"] + item[21:]
    apart = [w + "x" if i % 7 == 0 else w for i, w in enumerate(item)]
    rows = [(1, "before " + " ".join(item) + " after"), (2, " ".join(changed).upper()), (3, " ".join(apart)), (4, None), (5, ""), (6, " ".join(item[:55])), (7, "two words"), (7, "two words"), (None, " ".join(item)), (8, LONG + " " + " ".join(item) + " x " + " ".join(item)), (9, "has two words in it")]
    some = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hs", F.lit(1)).withColumn("size", F.lit(1))
    bench = spark.createDataFrame([(0, " ".join(item)), (0, " ".join(item)), (1, "two words"), (2, None), (3, ""), (None, "x y z u v w")], "item_id long, text string")
    want = set()
    for i, t in rows:
        for k, u in ((0, item), (1, ["two", "words"])):
            w = (t or "").lower().split()
            if i is None or not w or (len(u) < 5 and len(w) != len(u)):
                continue
            best = max(((similarity(w[s : s + len(u)], u), -s) for s in range(max(1, len(w) - len(u) + 1))))
            if best[0] >= 0.8:
                want.add((i, k, -best[1], min(len(u), len(w)), best[0]))
    got = {tuple(r) for r in decontaminate.leaks(some, bench).collect()}
    assert got == want and {x[0] for x in got} == {1, 2, 6, 7, 8}
    assert sorted(r.doc_id or -1 for r in decontaminate.keep_clean(some, bench).collect()) == [-1, 3, 4, 5, 9]
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_tool_calls(spark):
    schema = "conv_id long, turn long, kind string, call_id string, role string, name string, content string"
    rows = [(1, 0, "message", None, "system", None, None), (1, 1, "call", "b", None, "add", '{"y": 2, "x":1}'), (1, 2, "call", "a", None, "add", '{"x":"no"}'), (1, 3, "result", "a", None, None, "é"), (1, 4, "result", "zz", None, None, None), (1, 5, "call", "c", None, "none", "{}"), (1, 6, "call", "d", None, "add", "not json"), (1, 7, "call", "e", None, "add", '{"x":1,"z":1}'), (1, 8, "call", "f", None, "add", '{"x":1.5}'), (None, 1, "call", "a", None, "add", '{"x":1}'), (2, 1, "call", None, None, "add", '{"x":1}'), (2, 2, "call", "p", None, "add", None), (2, 3, "call", "q", None, "add", '{"x":1}')]
    needs = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "c", "a"), (1, "c", "nowhere"), (2, "p", "q"), (2, "q", "p")], "conv_id long, call_id string, needs_id string")
    schemas = {"add": {"x": ("integer", True), "y": ("number", False)}}
    schemas["add"]["x"] = ("integer", True)
    table = spark.createDataFrame(rows, schema).withColumn("level", F.lit(9)).drop("level")
    got = {(r.conv_id, r.turn): r for r in toolcalls.link(table, schemas, needs).collect()}
    assert len(got) == len(rows)
    assert got[1, 1].json == '{"arguments":{"x":1,"y":2},"id":"b","name":"add","type":"call"}'
    assert {k: v.valid for k, v in got.items() if v.kind == "call"} == {(1, 1): True, (1, 2): False, (1, 5): False, (1, 6): False, (1, 7): False, (1, 8): False, (None, 1): True, (2, 1): True, (2, 2): False, (2, 3): True}
    assert [got[1, t].level for t in (2, 1, 5, 3, 4)] == [0, 1, 2, 0, None] and got[2, 2].level is None
    assert got[1, 3].linked and got[1, 2].linked and not got[1, 4].linked and not got[None, 1].linked and got[1, 3].order_turn == 2
    assert got[1, 4].json == '{"call_id":"zz","content":null,"type":"result"}' and got[1, 6].json.startswith('{"arguments":null,')
    assert toolcalls.link(table.limit(0), schemas).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "x"), (None, None, None, None), (1, 5, "assistant", "y"), (1, 0, "user", None)], "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash"))
    linked = toolcalls.link(toolcalls.from_conversations(turns), {"reply": {"text": ("string", True)}}).collect()
    assert len(linked) == 5 and sorted((r.kind, r.linked) for r in linked) == [("call", True), ("call", True), ("message", False), ("result", False), ("result", True)]


def test_every_stage_of_the_pipeline(docs, none, spark, tmp_path):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, PROSE[4])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for source in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, source, str(tmp_path))
            n = out.count()
            assert name == "packing" or out.columns == docs.columns
            assert n == 0 if source is none else n > 0
    clean = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, str(tmp_path))
    assert 13 not in [r.doc_id for r in clean.collect()] and clean.count() == len(TEXTS) - 1
