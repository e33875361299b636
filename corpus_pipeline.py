"""A corpus from raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ngram_join, packing, pii, quality, substring
from tidemark.llm.components import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.keep_good(docs, quality.fit(docs, quality.training_labels(labels)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by 0.8 similar sets of five-word shingles, the one with the smallest id stays."""
    return ngram_join.keep_first(docs, ngram_join.Likeness(shingle=5, percent=80))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of twenty words or more that start earlier in the corpus go; documents all stay.

    A text that loses words is its other words joined by spaces; others stay as they are, and a null text
    becomes empty.
    """
    # Other columns travel under names that can't clash with the result's.
    others = {c: f"other_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    cut = substring.dedup(docs.withColumnsRenamed(others), list(others.values()), texts=True)
    back = cut.select("doc_id", F.col("kept_text").alias("text"), *[F.col(n).alias(c) for c, n in others.items()])
    return _as_documents(back, docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _as_documents(pii.redact(docs), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, by a row per sequence: its ids, and the pieces of documents they come from."""
    return packing.sequences(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


def _as_documents(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` counted anew."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# The stages' models, links and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
