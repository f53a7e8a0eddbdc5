"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, decontaminate, kdcodes, merkle, packing, pst, sharding, simhash, substring, toolcalls, toxicity, warc, wavelet
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"), width=4, radius=4)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op3_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64.0)


def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score_documents(table(spark, sf_dir, "documents"), held_out_fold=1)


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), length=2048, windows=8).drop("ids")


def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out_fold=0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"), window=13)


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(toolcalls.from_conversations(table(spark, sf_dir, "conversations")), {"reply": {"text": ("string", True)}})


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read(wavelet.write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op11_vector_bin_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: every shard's sizes add up to nearly the same."""
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=40)
    text = F.coalesce("text", F.lit(""))
    return placed.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = merkle.leaf(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns])
    proofs = merkle.manifest(docs, columns, "lang", "doc_id", shown=F.when(tampers, tampered))
    return merkle.verify(proofs).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_filtering_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdcodes.compress(table(spark, sf_dir, "embeddings"), scale=256.0, parts=16, entries=64, rounds=2)


SQL = {
    "op2_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
        m AS (SELECT hex, max(page_id) AS first FROM h GROUP BY hex)
        SELECT page_id, n AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + list_sum(list_transform(range(5), lambda j: ((instr('0123456789abcdef', substr(hex, (1 + (5 * i + j) // 4)::BIGINT, 1)) - 1) // (2 ** (3 - (5 * i + j) % 4))::BIGINT % 2) * (2 ** (4 - j))::BIGINT))::BIGINT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM h JOIN m USING (hex)""",
    "op3_ball_tree_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_tool_call_linking": """
        WITH c AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
                     CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id FROM conversations),
        k AS (SELECT call_id, min(turn) AS call_turn FROM c WHERE kind = 'call' AND call_id IS NOT NULL GROUP BY call_id),
        a AS (SELECT DISTINCT call_id AS answer FROM c WHERE kind = 'result' AND call_id IS NOT NULL)
        SELECT conv_id, turn, kind, c.call_id,
               CASE kind WHEN 'call' THEN answer IS NOT NULL WHEN 'result' THEN call_turn IS NOT NULL ELSE false END AS linked,
               CASE WHEN kind = 'call' THEN text IS NOT NULL END AS valid,
               CASE WHEN call_turn IS NOT NULL THEN 0 END AS level,
               coalesce(call_turn, turn) AS order_turn,
               CASE kind WHEN 'call' THEN '{"arguments":{"text":' || coalesce(to_json(text)::VARCHAR, 'null') || '},"id":' || coalesce(to_json(c.call_id)::VARCHAR, 'null') || ',"name":"reply","type":"call"}'
                         WHEN 'result' THEN '{"call_id":' || coalesce(to_json(c.call_id)::VARCHAR, 'null') || ',"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"type":"result"}'
                         ELSE '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"type":"message"}' END AS json
        FROM c LEFT JOIN k ON c.call_id = k.call_id LEFT JOIN a ON c.call_id = answer""",
    "op9_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
        ds AS (SELECT doc_id, len(w) AS n, unnest(range(len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
        ks AS (SELECT item_id, len(w) AS size, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i WHERE len(w) >= 5),
        kc AS (SELECT item_id, size, s, count(*) AS ci FROM ks GROUP BY ALL),
        hit AS (SELECT doc_id, n, p, item_id, size, s, ci FROM ds JOIN kc USING (s)),
        win AS (SELECT doc_id, item_id, size, n, least(size, n) - 4 AS m, s, ci, unnest(range(greatest(0, p - (size - 5)), least(p, greatest(0, n - size)) + 1)) AS start FROM hit),
        cnt AS (SELECT doc_id, item_id, size, m, start, s, ci, count(*) AS cw FROM win GROUP BY ALL),
        sim AS (SELECT doc_id, item_id, start, m + 4 AS n_words, sum(least(cw, ci)) / (m + size - 4 - sum(least(cw, ci)))::DOUBLE AS similarity FROM cnt GROUP BY doc_id, item_id, size, m, start)
        SELECT doc_id, item_id, start, n_words, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM sim WHERE similarity >= 0.8) WHERE r = 1""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
        k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM s),
        m AS (SELECT h, min(doc_id) AS low FROM k GROUP BY h),
        r AS (SELECT DISTINCT k.doc_id, i + j AS i FROM k JOIN m USING (h), range(13) t(j) WHERE low < k.doc_id),
        g AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
        o AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda x: gone IS NULL OR NOT list_contains(gone, x)) AS keep FROM d LEFT JOIN g USING (doc_id))
        SELECT doc_id, len(w) AS n_words, len(w) - len(keep) AS n_removed,
               sha256(coalesce(array_to_string(list_transform(keep, lambda x: w[x]), ' '), '')) AS kept_sha256 FROM o""",
    "op12_merkle_manifest": """
        WITH RECURSIVE f AS (
          SELECT doc_id, lang, crc32_of % 7 = 0 AS tampers, n_chars, a, t FROM (
            SELECT doc_id, lang, n_chars, xor(4294967295, list_reduce(list_transform(str_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295)) AS crc32_of,
                   coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
                   coalesce(octet_length(encode(text)) || ':' || text, '-') AS t FROM documents)),
        g AS (SELECT doc_id, lang, sha256(a || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || t) AS leaf,
                     sha256(a || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || t) AS other, tampers FROM f),
        l AS (SELECT doc_id, coalesce('l' || lang, '') AS part, leaf, CASE WHEN tampers THEN other ELSE leaf END AS shown,
                     row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM g),
        up AS (SELECT part, 0 AS level, pos, leaf AS h, n FROM l UNION ALL
               SELECT part, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM up WHERE n > 1 GROUP BY part, level, pos // 2),
        sub AS (SELECT part, h AS subroot, level AS height, row_number() OVER (ORDER BY part) - 1 AS place, count(*) OVER () AS parts FROM up WHERE n = 1),
        crown AS (SELECT 0 AS level, place AS pos, subroot AS h, parts AS n FROM sub UNION ALL
                  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM crown WHERE n > 1 GROUP BY level, pos // 2),
        ends AS (SELECT max(level) AS top, max(h) FILTER (WHERE n = 1) AS root FROM crown),
        steps AS (SELECT l.doc_id, l.leaf, l.pos AS own, l.part, k AS step, u.h, (l.pos >> k) % 2 = 1 AS sits_right FROM l JOIN sub USING (part), unnest(range(height)) r(k) LEFT JOIN up u ON u.part = l.part AND u.level = k AND u.pos = xor(l.pos >> k, 1)
                  UNION ALL
                  SELECT l.doc_id, l.leaf, l.pos, l.part, height + k, c.h, (place >> k) % 2 = 1 FROM l JOIN sub USING (part), ends, unnest(range(top)) r(k) LEFT JOIN crown c ON c.level = k AND c.pos = xor(place >> k, 1)),
        proof AS (SELECT part, own, list(CASE WHEN h IS NULL THEN '' WHEN sits_right THEN 'L' || h ELSE 'R' || h END ORDER BY step) AS s FROM steps GROUP BY part, own),
        folded AS (SELECT l.*, coalesce(s, []) AS s FROM l LEFT JOIN proof ON l.part = proof.part AND l.pos = own),
        done AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(s, lambda x: x[2:]), '')) AS proof_sha256,
                        list_reduce(s, lambda h, x: CASE WHEN x = '' THEN sha256(h) WHEN x[1] = 'L' THEN sha256(x[2:] || h) ELSE sha256(h || x[2:]) END, shown) AS folded_root
                 FROM folded JOIN sub USING (part), ends)
        SELECT *, folded_root = root AS verified FROM done""",
    "op13_filtering_lloyd_codes": """
        WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT vec_id, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS x FROM k, range(16) r(part)),
        b0 AS (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::INTEGER AS entry, x AS e FROM p QUALIFY entry < 64),
        a1 AS (SELECT part, vec_id, any_value(x) AS x, min({d: list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, i: entry}) AS near FROM p JOIN b0 USING (part) GROUP BY part, vec_id),
        m1 AS (SELECT part, near.i AS entry, c, sum(x[c]) AS s, count(*) AS n FROM a1, generate_series(1, len(x)) g(c) GROUP BY ALL),
        n1 AS (SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY c) AS e FROM m1 GROUP BY ALL),
        b1 AS (SELECT part, entry, coalesce(n1.e, b0.e) AS e FROM b0 LEFT JOIN n1 USING (part, entry)),
        a2 AS (SELECT part, vec_id, any_value(x) AS x, min({d: list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, i: entry}) AS near FROM p JOIN b1 USING (part) GROUP BY part, vec_id),
        m2 AS (SELECT part, near.i AS entry, c, sum(x[c]) AS s, count(*) AS n FROM a2, generate_series(1, len(x)) g(c) GROUP BY ALL),
        n2 AS (SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY c) AS e FROM m2 GROUP BY ALL),
        b2 AS (SELECT part, entry, coalesce(n2.e, b1.e) AS e FROM b1 LEFT JOIN n2 USING (part, entry)),
        a3 AS (SELECT part, vec_id, min({d: list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, i: entry}) AS near FROM p JOIN b2 USING (part) GROUP BY part, vec_id),
        o AS (SELECT vec_id, string_agg(printf('%02x', near.i), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a3 GROUP BY vec_id),
        t AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
        SELECT o.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN k USING (vec_id), t""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
