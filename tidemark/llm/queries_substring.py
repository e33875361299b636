"""op4: cut repeated passages from every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import substring
from tidemark.llm.arrow import documents


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op4_substring": op4_substring}
ORACLES: dict[str, str] = {}
