"""The corpus pipeline: each stage's result is written and read again as the next one's documents.

In every stage an empty table gives an empty one, rows with a null id stay (the packing numbers their pieces like any), rows that share an id
stay or go together, and columns beside those of documents are carried along whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkweave.llm import decontaminate, packing, queries, simhash, substring, toxicity
from hunkweave.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents scored 0.5 or more; labels of the fifth that op6 holds out stay out here too.

    Null and empty texts are scored like any; without labels of both kinds nothing is dropped.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out_fold=0)
    return toxicity.keep_clean(docs, model, threshold=0.5)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their five-word shingles the one with the smallest id stays.

    Null and empty texts are copies of each other, so one of them stays.
    """
    return simhash.keep_one(docs, width=5, similar=0.8)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that stand in a document with a smaller id.

    Null texts stay null; a text that is all cut is empty, and its row stays.
    """
    return substring.remove(docs, window=50).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark; null and empty texts hold none."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens; null and empty texts have the end token alone."""
    return packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"), length=2048, windows=8, keep_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]
#: The toxicity score and the packing depend on fitted models and tokenizers, which SQL has none of.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
