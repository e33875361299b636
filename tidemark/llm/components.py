"""Connected components of an edge table by repeated smallest labels and shortcuts, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: its lineage ends there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, label)`` for each end of ``edges (a, b)``: the smallest node that can be reached, itself included.

    Each round gives a node the smallest label among its neighbours, and that
    label's own label; the rounds needed grow with the logarithm of the
    longest path. A node with very many edges is a skewed key of a sort-merge
    join, which Spark splits, and its labels combine before their shuffle.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        lower = labels.join(near, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("before"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = lower.join(own, "label", "left").select(
            "node", F.least("label", F.coalesce("further", "label")).alias("label"), "before"
        )
        found = written(jumped, "labels")
        if not found.where("label <> before").head(1):
            return found.select("node", "label")
        labels = found.select("node", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

