"""Bounded samples of rows for training small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place() -> Column:
    """A row's place in the sampling order: a hash of its id."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def first_in_order(ids: DataFrame, rows: int) -> list[int]:
    """The ``rows`` smallest distinct places of ``ids``; only places reach the driver."""
    return [r[0] for r in ids.select(place().alias("place")).distinct().orderBy("place").limit(rows).collect()]


def texts_at(docs: DataFrame, places: list[int]) -> dict[int, str]:
    """The whole text for each of a bounded list of places; of rows with the same id the smallest text."""
    if not places:
        return {}
    wanted = docs.sparkSession.createDataFrame([(p,) for p in places], "place long")
    found = docs.select(place().alias("place"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "place")
    return {r["place"]: r["text"] for r in found.groupBy("place").agg(F.min("text").alias("text")).collect()}
