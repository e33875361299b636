"""The ready-made jobs, as transforms from raw rows to what the sink gets.

Most work on a batch and on a stream. Jobs that number rows come as a
``Counting``, which a batch runs as one DataFrame and a stream micro-batch by
micro-batch, with the counts so far stored beside the results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import (
    append_text,
    divisible_by,
    lowercase,
    number_after,
    prefix_text,
    strict_long,
)
from tidemark.operators.campaigns import COUNTED_EVENT, ad_views, campaign_counts
from tidemark.operators.counting import RUN_LENGTH, counted_text, run_id, running_count, running_count_of_equals
from tidemark.operators.enrich import enrich
from tidemark.operators.folds import COUNT_AND_LATEST
from tidemark.operators.new_users import STREAM_SALTS, new_users_with_auctions
from tidemark.operators.reports import (
    campaign_latency_report,
    new_user_latency_report,
    number_latency_report,
    region_report,
)
from tidemark.operators.windows import (
    CAMPAIGN_WINDOW,
    NEW_USER_WINDOW,
    assign_region,
    event_time,
    sliding_count,
    windowed_count,
    with_ingest_time,
)
from tidemark.sources.parse import (
    parse_ad_events,
    parse_auctions,
    parse_geo_events,
    parse_persons,
    parse_timestamped_numbers,
)
from tidemark.streaming.closing import close_windows
from tidemark.streaming.config import StreamConfig
from tidemark.streaming.counting import count_stream
from tidemark.streaming.panes import clock_fold, fired_fold

# Counters that rows are dealt to.
SHARDS = 256


def _value(column) -> list:
    return [column.alias("value")]


def lowercase_text(lines: DataFrame) -> DataFrame:
    return lines.select(*_value(lowercase(F.col("value"))))


def appended_text(lines: DataFrame) -> DataFrame:
    return lines.select(*_value(append_text(F.col("value"))))


def even_lines(lines: DataFrame) -> DataFrame:
    """Lines whose number, from the eleventh character on, is even, behind a prefix."""
    number = strict_long(number_after(F.col("value")))
    return lines.where(divisible_by(number, 2)).select(*_value(prefix_text(F.col("value"))))


@dataclass(frozen=True)
class Counting:
    """Rows to be numbered per ``shard`` along ``order``, and what is made of the numbered rows.

    A shard is a logical key: the same rows have the same shards in a batch and
    in a stream, whatever files and partitions they come in. Where many rows
    may be ``equal`` in all columns, they are counted before they are numbered.
    With ``shards``, the number of shards, a stream may go on with another one.
    """

    rows: DataFrame
    order: list[str]
    finish: Callable[[DataFrame], DataFrame]
    equal: bool = False
    shards: int | None = None

    def batch(self) -> DataFrame:
        number = running_count_of_equals if self.equal else running_count
        return self.finish(number(self.rows, "shard", self.order))

    def stream(
        self, path: str, config: StreamConfig, form: str = "parquet", land: Callable[[DataFrame, int], None] | None = None
    ) -> StreamingQuery:
        """Number micro-batch by micro-batch, each along the order; results land in ``<path>/rows``, or where ``land``
        puts them."""
        return count_stream(
            self.rows, "shard", self.order, path, config, then=self.finish, form=form, equal=self.equal, shards=self.shards, land=land
        )


def _shard(number: Column, shards: int) -> Column:
    return F.pmod(number, F.lit(shards)).cast("string")


def counted_lines(lines: DataFrame, shards: int = SHARDS) -> Counting:
    """``value - shard - count`` of lines. Lines have no order of their own: they are dealt and ordered by their hash."""
    place = F.conv(F.substring(F.md5(F.encode("value", "UTF-8")), 1, 13), 16, 10).cast("long")
    rows = lines.select("value", place.alias("place"), _shard(place, shards).alias("shard"))
    return Counting(rows, ["place", "value"], _as_text, equal=True, shards=shards)


def _as_text(counted: DataFrame) -> DataFrame:
    return counted.select(*_value(counted_text(F.col("value"), F.col("shard"), F.col("seq"))))


def counted_numbers(numbers: DataFrame) -> Counting:
    """``value - shard - count`` of the numbers of an interval, by their own shard."""
    return Counting(numbers.select("value", "shard"), ["value"], _as_text)


def counted_even_numbers(numbers: DataFrame) -> Counting:
    return counted_numbers(numbers.where(divisible_by(F.col("value"), 2)))


def number_latencies(
    lines: DataFrame,
    shards: int = SHARDS,
    only_latency: bool = True,
    every: int = 1,
    multiples_of: int | None = None,
    as_of: datetime | None = None,
) -> Counting:
    """Latency of every n-th timestamped number of a shard, all of them or only some multiples.

    Numbers are dealt by their remainder and ordered by their value, then their time.
    """
    if every < 1:
        raise ValueError("every must be at least 1")
    numbers = parse_timestamped_numbers(lines)
    if multiples_of:
        numbers = numbers.where(divisible_by(F.col("value"), multiples_of))

    def finish(counted: DataFrame) -> DataFrame:
        kept = counted.where(F.col("seq") % F.lit(every) == 0) if every > 1 else counted
        return number_latency_report(kept, only_latency, as_of)

    return Counting(numbers.withColumn("shard", _shard(F.col("value"), shards)), ["value", "event_time"], finish, shards=shards)


def region_counts(
    lines: DataFrame,
    size_seconds: int = 60,
    slide_seconds: int = 30,
    at: datetime | None = None,
) -> DataFrame:
    """Events per region in sliding windows over the time of processing, or over ``at``."""
    stamped = with_ingest_time(parse_geo_events(lines), at)
    regional = event_time(stamped, "ingest_time").select(
        assign_region(F.col("lat"), F.col("lng")).alias("region"), "ingest_time"
    )
    return sliding_count(regional, "region", "ingest_time", size_seconds, slide_seconds)


def region_latencies(
    lines: DataFrame,
    size_seconds: int = 60,
    slide_seconds: int = 30,
    as_of: datetime | None = None,
) -> DataFrame:
    return region_report(region_counts(lines, size_seconds, slide_seconds), as_of)


def region_panes(lines: DataFrame, size_seconds: int = 60, slide_seconds: int = 30) -> DataFrame:
    """Events per region in sliding windows over the time of processing, of a stream that runs until it is stopped: a
    window comes when the clock has passed its end, with or without further input."""
    events = parse_geo_events(lines).select(assign_region(F.col("lat"), F.col("lng")).alias("region"))
    return clock_fold(events, "region", f"{size_seconds} seconds", slide=f"{slide_seconds} seconds")


def new_user_latencies(
    person_lines: DataFrame,
    auction_lines: DataFrame,
    width: str = NEW_USER_WINDOW,
    delay: str = "0 seconds",
    as_of: datetime | None = None,
    evicted_at="window end",
    salts: int = STREAM_SALTS,
) -> DataFrame:
    """Latencies of auctions opened in the window their person is new in.

    A window counts as evicted when it ends, or at ``evicted_at``: a time, or None for the clock.
    """
    persons = event_time(parse_persons(person_lines), "event_time", delay)
    auctions = event_time(parse_auctions(auction_lines), "event_time", delay)
    found = new_users_with_auctions(persons, auctions, width, evicted_at, salts)
    return new_user_latency_report(found, as_of)


def campaign_window_counts(
    lines: DataFrame,
    campaigns: DataFrame | None = None,
    width: str = CAMPAIGN_WINDOW,
    delay: str = "0 seconds",
    missing: str = "error",
    shards: int = SHARDS,
) -> DataFrame:
    """Views per campaign and window.

    With a campaign table its campaigns are counted. Without one, lines are
    numbered ones, and ten successive views of a shard (the remainder of their
    numbers) make up a campaign; a batch only, see ``campaign_run_stream``.
    """
    if campaigns is not None:
        views = event_time(ad_views(parse_ad_events(lines)), "event_time", delay)
        return campaign_counts(views, campaigns, width, missing)
    return run_window_counts(campaign_runs(lines, shards).batch(), width, delay)


def campaign_panes(
    lines: DataFrame, campaigns: DataFrame, width: str = CAMPAIGN_WINDOW, delay: str = "0 seconds", missing: str = "error", every_ms: int = 0
) -> DataFrame:
    """Views per campaign and window of a stream that runs until it is stopped: early rows every ``every_ms``, whether
    anything has changed or not, and a final one per pane (see ``streaming.panes``)."""
    views = enrich(ad_views(parse_ad_events(lines)), campaigns.select("ad_id", "campaign_id"), "ad_id", missing)
    timed = views.select("campaign_id", "event_time", F.unix_micros("event_time").alias("event_us"))
    panes = fired_fold(timed, "campaign_id", "event_time", width, COUNT_AND_LATEST, every_ms, delay)
    latest = F.timestamp_micros("last_update_us").alias("last_update")
    return panes.select("window_start", "campaign_id", "count", latest, "final")


def campaign_runs(lines: DataFrame, shards: int = SHARDS) -> Counting:
    """Numbered views with the run of ten successive ones of their shard as their campaign."""
    views = parse_ad_events(lines, numbered=True).where(F.col("event_type") == COUNTED_EVENT)
    rows = views.select("id", "ad_id", "event_time", _shard(F.col("id"), shards).alias("shard"))

    def finish(counted: DataFrame) -> DataFrame:
        campaign = run_id(F.col("shard"), F.col("seq"), RUN_LENGTH).alias("campaign_id")
        return counted.select("ad_id", "event_time", campaign)

    return Counting(rows, ["id"], finish)


def run_window_counts(runs: DataFrame, width: str = CAMPAIGN_WINDOW, delay: str = "0 seconds") -> DataFrame:
    return windowed_count(event_time(runs, "event_time", delay), "campaign_id", "event_time", width)


def campaign_run_stream(
    lines: DataFrame,
    path: str,
    config: StreamConfig,
    width: str = CAMPAIGN_WINDOW,
    delay: str = "0 seconds",
    shards: int = SHARDS,
    as_of: datetime | None = None,
    form: str = "parquet",
) -> StreamingQuery:
    """Latency reports of campaigns made of runs, of a stream: one query numbers each micro-batch's views and adds them
    to the windows still open. Closed windows land in ``<path>/rows``; see ``streaming.closing``."""

    def land(runs: DataFrame, batch_id: int) -> None:
        report = lambda counts: campaign_latency_report(counts, as_of)
        close_windows(runs, batch_id, path, "campaign_id", "event_time", width, delay, report, form)

    return campaign_runs(lines, shards).stream(path, config, land=land)


def campaign_latencies(
    lines: DataFrame,
    campaigns: DataFrame | None = None,
    width: str = CAMPAIGN_WINDOW,
    delay: str = "0 seconds",
    missing: str = "error",
    as_of: datetime | None = None,
    shards: int = SHARDS,
) -> DataFrame:
    counts = campaign_window_counts(lines, campaigns, width, delay, missing, shards)
    return campaign_latency_report(counts, as_of)
