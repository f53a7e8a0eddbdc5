"""The pipeline on planted documents, each stage against a plain form of its rule on what the stage before kept."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from hunkweave.llm import queries, tokens
from hunkweave.llm.common import written


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_pipeline_on_planted_documents(spark, tmp_path):
    random.seed(4)
    clean = ["".join(random.choice(["ba", "ko", "ri", "mu", "te", "so", "la"]) for _ in range(4)) for _ in range(900)]
    bad = "vilescum rottenfool trashmouth".split()
    rows = {}
    for i in range(300):
        w = random.choices(clean, k=random.randint(40, 90))
        for _ in range(6 if i % 5 == 0 else 0):
            w.insert(random.randrange(len(w)), random.choice(bad))
        rows[i] = w
    passage, item = random.choices(clean, k=60), random.choices(clean, k=40)
    rows[301] = [*rows[1], "more"]  # a near copy
    rows[302], rows[303] = [*rows[2][:30], *passage], [*rows[3][:30], *passage]  # a passage that repeats
    rows[304] = [*rows[4][:20], *item, *rows[6][:20]]  # a leak
    docs = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in rows.items()] + [(400, None, "en", "s", None), (401, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = written(stage(spark, held, str(tmp_path)), name)
        kept.append({r.doc_id: r.text for r in held.collect()})
    toxic = {i for i in rows if i < 300 and i % 5 == 0}
    assert len(toxic - kept[0].keys()) >= 0.95 * len(toxic) and len(set(rows) - toxic - kept[0].keys()) <= 3

    ids, low = sorted(kept[0]), {}
    sets = {i: shingles(kept[0][i] or "") for i in ids}
    for i in ids:
        low[i] = next((low[j] for j in ids if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])), i)
    assert sorted(kept[1]) == [i for i in ids if low[i] == i] and not {301, 401} & kept[1].keys()

    first = {}
    for i in sorted(kept[1]):
        w = (kept[1][i] or "").split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, text in kept[1].items():
        w = (text or "").split()
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        assert (kept[2][i] or "").split() == [x for k, x in enumerate(w) if k not in gone]
    assert (len(kept[2][302].split()), len(kept[2][303].split())) == (90, 30)
    assert kept[2].keys() - kept[3].keys() == {304}

    encoder = tokens.encoder(queries.tokenizer_path("byte_bpe_50k.json"))
    want = {i: np.append(np.frombuffer(encoder.ids(t), "<u4"), tokens.END).tolist() for i, t in kept[3].items()}
    got: dict = {}
    for r in sorted(corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path)).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want
