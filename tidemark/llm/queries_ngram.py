"""op3: components of documents whose sets of word shingles are nearly the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ngram_join
from tidemark.llm.arrow import documents


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), ngram_join.Likeness(shingle=3, percent=90))


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLES: dict[str, str] = {}
