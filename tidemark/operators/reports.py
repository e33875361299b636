"""Latency reports: what each job writes next to, or instead of, its results.

``as_of`` is the time latencies are taken at; left out, it is the clock.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import epoch_ms, latency_ms, now_or

AsOf = datetime | Column | None


def number_latency_report(
    counted: DataFrame, only_latency: bool = True, as_of: AsOf = None
) -> DataFrame:
    """``latency_ms, value`` of counted numbers, and ``shard, seq`` unless only latency counts."""
    extra = [] if only_latency else ["shard", "seq"]
    latency = latency_ms(F.col("event_time"), as_of)
    return counted.select(latency.alias("latency_ms"), "value", *extra)


def campaign_latency_report(counts: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Campaign, count, age of its latest event, start of the window."""
    return counts.select(
        "campaign_id",
        "count",
        latency_ms(F.col("last_update"), as_of).alias("latency_ms"),
        epoch_ms(F.col("window_start")).alias("window_ms"),
    )


def new_user_latency_report(results: DataFrame, as_of: AsOf = None) -> DataFrame:
    """The time itself, ages of eviction, auction and person, and who it is."""
    now = epoch_ms(now_or(as_of))
    return results.select(
        now.alias("now_ms"),
        (now - F.col("window_evicting")).alias("eviction_latency_ms"),
        (now - F.col("auction_creation")).alias("auction_latency_ms"),
        (now - F.col("person_creation")).alias("person_latency_ms"),
        "person_id",
        "person_name",
    )


def region_report(counts: DataFrame, as_of: AsOf = None) -> DataFrame:
    """The time itself, region and count."""
    return counts.select(epoch_ms(now_or(as_of)).alias("now_ms"), "region", "count")
