"""op10: the 20 nearest vectors of every twentieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import nearest


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest.search(vectors, F.col("vec_id") % 20 == 0, k=20)


QUERIES = {"op10_nearest": op10_nearest}
ORACLES: dict[str, str] = {}
