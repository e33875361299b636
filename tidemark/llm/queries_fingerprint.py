"""op8: fingerprint every document and its edited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import fingerprint
from tidemark.llm.arrow import documents


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


QUERIES = {"op8_fingerprint": op8_fingerprint}
ORACLES: dict[str, str] = {}
