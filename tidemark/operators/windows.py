"""Event time and windowed counts."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tidemark.functions.time import now_or

# Number of regions, and widths the jobs use by default.
REGIONS = 16
CAMPAIGN_WINDOW = "10 seconds"
NEW_USER_WINDOW = "30 seconds"
REGION_WINDOW, REGION_SLIDE = "60 seconds", "30 seconds"

# Session zones in which a zone-less time is read as UTC by a plain cast.
UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def event_time(df: DataFrame, column: str, delay: str = "0 seconds") -> DataFrame:
    """Make ``column`` the event time of a stream; zone-less times are read as UTC in any session zone.

    With no delay, times are expected to rise. Spark follows the latest time
    over all input partitions, so a stream read from several unaligned
    partitions needs a delay as long as they drift apart.
    """
    time = F.col(column).cast("timestamp")
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if isinstance(df.schema[column].dataType, TimestampNTZType) and zone not in UTC_NAMES:
        days, seconds = F.unix_date(F.to_date(column)), F.expr(f"extract(SECOND FROM `{column}`)")
        minutes = (days * 24 + F.hour(column)) * 60 + F.minute(column)
        time = F.timestamp_micros(minutes.cast("long") * 60_000_000 + (seconds * 1_000_000).cast("long"))
    df = df.withColumn(column, time)
    return df.withWatermark(column, delay) if df.isStreaming else df


def with_ingest_time(df: DataFrame, at=None, column: str = "ingest_time") -> DataFrame:
    """Stamp rows with the time of processing, or with ``at``."""
    return df.withColumn(column, now_or(at))


def windowed_count(df: DataFrame, key: str, time: str, width: str) -> DataFrame:
    """Rows and latest time per tumbling window and key.

    Both aggregates combine before the shuffle, so a key with most of the rows
    costs one row per window and map task.
    """
    return (
        df.groupBy(F.window(time, width).alias("window"), F.col(key))
        .agg(F.count("*").alias("count"), F.max(time).alias("last_update"))
        .select(F.col("window.start").alias("window_start"), key, "count", "last_update")
    )


def assign_region(lat: Column, lng: Column, regions: int = REGIONS) -> Column:
    """Region of a coordinate pair: ``(31 lat + lng) mod regions``, free of overflow."""
    n = F.lit(regions)
    return F.pmod(F.pmod(lat, n) * 31 + F.pmod(lng, n), n).cast("int")


def sliding_count(
    df: DataFrame, key: str, time: str, size_seconds: int, slide_seconds: int
) -> DataFrame:
    """Rows per sliding window and key.

    A batch is first counted per pane, the longest stretch that lies wholly in
    or out of every window; only the counts are then copied into the
    ``size / slide`` windows they belong to, not the rows. With a slide above
    the size there are gaps between windows, and rows in them are not counted.
    """
    size, slide = f"{size_seconds} seconds", f"{slide_seconds} seconds"
    if slide_seconds > size_seconds:
        end = F.col("window.start") + F.expr(f"INTERVAL {size_seconds} SECONDS")
        rows = df.withColumn("window", F.window(time, slide)).where(F.col(time) < end)
        counts = rows.select("window", key).groupBy("window", key).agg(F.count("*").alias("count"))
        return counts.select(
            F.col("window.start").alias("window_start"), end.alias("window_end"), key, "count"
        )
    if df.isStreaming:
        counts = df.groupBy(F.window(time, size, slide).alias("window"), F.col(key)).agg(
            F.count("*").alias("count")
        )
    else:
        pane = f"{gcd(size_seconds, slide_seconds)} seconds"
        panes = df.groupBy(F.window(time, pane).alias("pane"), F.col(key)).agg(
            F.count("*").alias("count")
        )
        counts = (
            panes.select(key, F.col("pane.start").alias("start"), "count")
            .groupBy(F.window("start", size, slide).alias("window"), F.col(key))
            .agg(F.sum("count").alias("count"))
        )
    return counts.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        key,
        "count",
    )
