"""op13: hard negatives of every fiftieth vector, over labels of which some are moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import negatives

SCALE, LABELS = 256, 10


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    vectors = negatives.whole_vectors(rows, moved, "embedding", SCALE)
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES: dict[str, str] = {}
