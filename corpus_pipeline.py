"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and gives the documents that it keeps, or, for
the last, the packed pieces. ``run`` applies them in turn, each to what its predecessor wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillfold.llm import decontaminate, language_id, minhash, packing, secrets
from quillfold.llm.work import discard, spool, transient


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold; documents without a clear language go."""
    model = language_id.fit(docs.where(~language_id.held_out("doc_id")))
    return language_id.known(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the document with the least id of each group stays."""
    return minhash.without_duplicates(docs, words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become the name of their kind."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 2048 ids."""
    return packing.pack(docs).placed


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage, written and read again; a stage's input and scratch tables go once its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with transient() as held:
            docs = held.keep(spool(stage(spark, docs, sf_dir)))
        if before is not None:
            discard(before)
        before = docs
    return docs


#: Language identification, tokenizers and packing have no SQL form; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None
