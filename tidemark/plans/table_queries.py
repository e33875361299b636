"""Every operator as a query over the driver tables, with its SQL counterpart.

``events`` plays the streams: views are ad views, signups new persons,
purchases auctions. ``customer`` is the ad-to-campaign dimension, and
``customer`` and ``orders`` are written out as raw lines and parsed back.
Times leave a query as epoch milliseconds or microseconds.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions import (
    append_text,
    divisible_by,
    epoch_ms,
    lowercase,
    number_after,
    prefix_text,
    strict_long,
    without_cr,
)
from tidemark.operators.campaigns import COUNTED_EVENT, ad_views, campaign_counts
from tidemark.operators.counting import assign_runs, counted_text, every_nth, running_count, running_count_of_equals
from tidemark.operators.enrich import enrich
from tidemark.operators.folds import COUNT_AND_LATEST, GROUP, START, windowed_apply, windowed_cogroup, windowed_fold
from tidemark.operators.new_users import new_user_auction_pairs, new_users_with_auctions
from tidemark.operators.reports import (
    campaign_latency_report,
    new_user_latency_report,
    number_latency_report,
    region_report,
)
from tidemark.operators.windows import (
    assign_region,
    event_time,
    sliding_count,
    windowed_count,
)
from tidemark.plans import jobs
from tidemark.session import parallelism, scratch_path
from tidemark.sources.parse import (
    parse_ad_events,
    parse_auctions,
    parse_geo_events,
    parse_persons,
    parse_timestamped_numbers,
)
from tidemark.sources.lines import text_lines
from tidemark.sources.sequence import interval_sequence, interval_sequence_stream, run_to_end
from tidemark.sinks.panes import read_panes, store_panes
from tidemark.sources.tables import read_table, stream_table
from tidemark.streaming.closing import read_closed
from tidemark.streaming.config import StreamConfig
from tidemark.streaming.counting import count_stream, read_counted, stateful_count
from tidemark.streaming.panes import clock_fold, fired_fold, nothing_open, quiet, run_until
from tidemark.streaming.run import run_available_now

Query = Callable[[SparkSession, str], DataFrame]

HOUR, DAY = 3600, 86400
SHARDS = 4
# A stream counts a shard in one task, so there are more of them, all of a size.
STREAM_SHARDS = 1000
NTH = 3
# A fixed "now" for reports, so that two engines agree on it.
AS_OF = datetime(2024, 2, 1, tzinfo=timezone.utc)
AS_OF_MS = int(AS_OF.timestamp() * 1000)

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, key: str | None = None):
    """Register a query, by its function's name or ``key``, with SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[key or function.__name__] = function
        ORACLES[key or function.__name__] = sql
        return function

    return register


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time))


# --- the tables in their roles -------------------------------------------------


def _events(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    table = stream_table if streaming else read_table
    return event_time(table(spark, folder, "events"), "ts")


def _ad_views(events: DataFrame) -> DataFrame:
    return ad_views(events.withColumnsRenamed({"user_id": "ad_id", "ts": "event_time"}))


def _campaigns(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("ad_id"), F.col("c_mktsegment").alias("campaign_id")
    )


def _persons(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "signup").select(
        epoch_ms(F.col("ts")).alias("timestamp"),
        F.col("user_id").alias("person_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"),
        F.col("ts").alias("event_time"),
        F.lit(AS_OF_MS).alias("ingestion_timestamp"),
    )


def _auctions(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "purchase").select(
        epoch_ms(F.col("ts")).alias("timestamp"),
        F.col("event_id").alias("auction_id"),
        F.col("user_id").alias("person_id"),
        F.col("ts").alias("event_time"),
        F.lit(AS_OF_MS).alias("ingestion_timestamp"),
    )


def _numbers(events: DataFrame) -> DataFrame:
    """Events as numbers; the shard stands in for the instance that read them."""
    shard = F.pmod(F.col("event_id"), F.lit(SHARDS)).cast("string")
    return events.select(
        F.col("ts").alias("event_time"), F.col("event_id").alias("value"), shard.alias("shard")
    )


def _shown_counts(counts: DataFrame) -> DataFrame:
    return counts.select(
        micros("window_start").alias("window_start_us"),
        "campaign_id",
        "count",
        micros("last_update").alias("last_update_us"),
    )


# --- campaign counts -----------------------------------------------------------

_CAMPAIGN_SQL = f"""
SELECT epoch_us(e.ts) // {HOUR}000000 * {HOUR}000000 AS window_start_us,
       c.c_mktsegment AS campaign_id, count(*) AS "count", max(epoch_us(e.ts)) AS last_update_us
FROM events e JOIN customer c ON c.c_custkey = e.user_id
WHERE e.event_type = 'view' GROUP BY 1, 2
"""


def _campaign_counts(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    views = _ad_views(_events(spark, folder, streaming))
    return campaign_counts(views, _campaigns(spark, folder), f"{HOUR} seconds")


@query(_CAMPAIGN_SQL)
def campaign_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_counts(_campaign_counts(spark, folder))


@query(_CAMPAIGN_SQL)
def campaign_window_counts_large(spark: SparkSession, folder: str) -> DataFrame:
    """The way taken for a campaign table that is too large to broadcast."""
    counts = campaign_counts(
        _ad_views(_events(spark, folder)),
        _campaigns(spark, folder),
        f"{HOUR} seconds",
        broadcast_bytes=0,
    )
    return _shown_counts(counts)


@query(
    f"""SELECT * FROM ({_CAMPAIGN_SQL}) WHERE window_start_us + {HOUR}000000 <=
    (SELECT max(epoch_us(ts)) FROM events WHERE event_type = 'view')"""
)
def campaign_window_counts_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Windows the watermark has closed; the last one is still open."""
    return _shown_counts(run_available_now(_campaign_counts(spark, folder, streaming=True)))


@query(ORACLES["campaign_window_counts_stream"])
def campaign_window_counts_large_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a campaign table that is too large to broadcast."""
    views = _ad_views(_events(spark, folder, streaming=True))
    counts = campaign_counts(views, _campaigns(spark, folder), f"{HOUR} seconds", broadcast_bytes=0)
    return _shown_counts(run_available_now(counts))


@query(_CAMPAIGN_SQL)
def campaign_early_firing(spark: SparkSession, folder: str) -> DataFrame:
    """All windows, open ones included, each in its latest version."""
    counts = _campaign_counts(spark, folder, streaming=True)
    latest = run_available_now(counts, latest_by=["window_start", "campaign_id"])
    return _shown_counts(latest)


@query(
    """SELECT e.user_id AS ad_id, epoch_us(e.ts) AS event_us, e.event_id, c.c_mktsegment AS
    campaign_id FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id"""
)
def campaign_enrich(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder).select(
        F.col("user_id").alias("ad_id"), micros("ts").alias("event_us"), "event_id"
    )
    return enrich(events, _campaigns(spark, folder), "ad_id")


@query(
    """SELECT e.user_id AS ad_id, e.event_id, c.c_mktsegment AS campaign_id
    FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id"""
)
def campaign_enrich_large(spark: SparkSession, folder: str) -> DataFrame:
    """The way taken for a dimension that is too large to broadcast."""
    events = _events(spark, folder).select(F.col("user_id").alias("ad_id"), "event_id")
    return enrich(
        events, _campaigns(spark, folder), "ad_id", missing="keep", broadcast_bytes=0
    )


@query(
    f"""WITH v AS (SELECT event_id % {SHARDS} AS shard, epoch_us(ts) AS us, row_number() OVER
        (PARTITION BY event_id % {SHARDS} ORDER BY event_id) AS seq
        FROM events WHERE event_type = 'view')
    SELECT us // {HOUR}000000 * {HOUR}000000 AS window_start_us,
        shard || '-' || ((seq - 1) // 10) AS campaign_id, count(*) AS "count",
        max(us) AS last_update_us FROM v GROUP BY 1, 2"""
)
def run_grouped_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Campaigns that are runs of ten successive views of a shard."""
    views = _numbers(_events(spark, folder).where(F.col("event_type") == COUNTED_EVENT))
    runs = assign_runs(views, "shard", "value")
    counts = windowed_count(runs, "campaign_id", "event_time", f"{HOUR} seconds")
    return _shown_counts(counts)


# --- new users with auctions ---------------------------------------------------

_DAY_US = DAY * 1_000_000
_NEW_USERS_SQL = f"""
SELECT (p.day + 1) * {DAY}000 AS window_evicting, p.created AS person_creation,
       {AS_OF_MS}::BIGINT AS person_ingestion, epoch_us(a.ts) // 1000 AS auction_creation,
       {AS_OF_MS}::BIGINT AS auction_ingestion, p.user_id AS person_id,
       'user ' || p.user_id AS person_name
FROM (SELECT user_id, epoch_us(ts) // {_DAY_US} AS day, {{created}} AS created
      FROM events WHERE event_type = 'signup' {{grouping}}) p
JOIN events a ON a.event_type = 'purchase' AND a.user_id = p.user_id
     AND epoch_us(a.ts) // {_DAY_US} = p.day
"""
_FIRST_SQL = _NEW_USERS_SQL.format(created="min(epoch_us(ts) // 1000)", grouping="GROUP BY 1, 2")
_PAIRS_SQL = _NEW_USERS_SQL.format(created="epoch_us(ts) // 1000", grouping="")
_CLOSED_DAYS_SQL = """WHERE window_evicting * 1000 <= (SELECT least(
    max(epoch_us(ts)) FILTER (event_type = 'signup'),
    max(epoch_us(ts)) FILTER (event_type = 'purchase')) FROM events)"""


def _new_users(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    return new_users_with_auctions(_persons(events), _auctions(events), f"{DAY} seconds")


@query(_FIRST_SQL)
def new_user_auctions(spark: SparkSession, folder: str) -> DataFrame:
    return _new_users(spark, folder)


@query(f"SELECT * FROM ({_FIRST_SQL}) {_CLOSED_DAYS_SQL}")
def new_user_auctions_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Days the watermark has closed."""
    persons = _persons(_events(spark, folder, streaming=True))
    auctions = _auctions(_events(spark, folder, streaming=True))
    return run_available_now(new_users_with_auctions(persons, auctions, f"{DAY} seconds"))


@query(_PAIRS_SQL)
def new_user_auctions_pairs(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    return new_user_auction_pairs(_persons(events), _auctions(events), f"{DAY} seconds")


@query(_PAIRS_SQL)
def new_user_auctions_pairs_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs need no closed window: a row appears as soon as both sides have."""
    persons = _persons(_events(spark, folder, streaming=True))
    auctions = _auctions(_events(spark, folder, streaming=True))
    return run_available_now(new_user_auction_pairs(persons, auctions, f"{DAY} seconds"))


# --- folds and functions of one's own ------------------------------------------------


def _campaign_views(spark: SparkSession, folder: str) -> DataFrame:
    views = enrich(_ad_views(_events(spark, folder)), _campaigns(spark, folder), "ad_id")
    return views.withColumn("event_us", micros("event_time"))


@query(_CAMPAIGN_SQL)
def campaign_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Campaign counts by a fold in Python: partial results per task, merged per window and campaign."""
    counts = windowed_fold(_campaign_views(spark, folder), "campaign_id", "event_time", f"{HOUR} seconds", COUNT_AND_LATEST)
    return counts.select(micros("window_start").alias("window_start_us"), "campaign_id", "count", "last_update_us")


_MEDIAN_SQL = f"""SELECT epoch_us(ts) // {_DAY_US} * {_DAY_US} AS window_start_us, event_type,
    median(user_id)::DOUBLE AS median_user, count(*) AS "count" FROM events GROUP BY 1, 2"""
_MEDIAN = "window_start_us long, event_type string, median_user double, count long"


def _median(at: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(*at, float(rows["user_id"].median()), len(rows))], columns=["window_start_us", "event_type", "median_user", "count"])


@query(_MEDIAN_SQL)
def window_median(spark: SparkSession, folder: str) -> DataFrame:
    """What can't be merged from partial results: a function over all rows of a day and kind."""
    events = _events(spark, folder).select("ts", "event_type", "user_id")
    return windowed_apply(events, "event_type", "ts", f"{DAY} seconds", _median, _MEDIAN)


@query(f"SELECT * FROM ({_MEDIAN_SQL}) WHERE window_start_us + {_DAY_US} <= (SELECT max(epoch_us(ts)) FROM events)")
def window_median_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Days the watermark has closed."""
    events = _events(spark, folder, streaming=True).select("ts", "event_type", "user_id")
    return run_available_now(windowed_apply(events, "event_type", "ts", f"{DAY} seconds", _median, _MEDIAN))


_NEW_USER_ROWS = (
    "window_evicting long, person_creation long, person_ingestion long, auction_creation long, auction_ingestion long, "
    "person_id long, person_name string"
)


def _first_persons(persons: pd.DataFrame, auctions: pd.DataFrame) -> pd.DataFrame:
    """The auctions of windows and persons, where the person is new: behind the earliest of the persons with that id."""
    in_order = persons.sort_values(["timestamp", "ingestion_timestamp", "name"])
    firsts = in_order.drop_duplicates(GROUP).set_index(GROUP)[["timestamp", "ingestion_timestamp", "name"]]
    met = auctions.join(firsts, GROUP, "inner", rsuffix="_person")
    columns = {
        "window_evicting": (met[START] + _DAY_US) // 1000,
        "person_creation": met["timestamp_person"],
        "person_ingestion": met["ingestion_timestamp_person"],
        "auction_creation": met["timestamp"],
        "auction_ingestion": met["ingestion_timestamp"],
        "person_id": met["person_id"],
        "person_name": met["name"],
    }
    return pd.DataFrame(columns)


def _cogrouped(events: DataFrame) -> DataFrame:
    return windowed_cogroup(_persons(events), _auctions(events), "person_id", "event_time", f"{DAY} seconds", _first_persons, _NEW_USER_ROWS, at_once=True)


@query(_FIRST_SQL)
def new_user_auctions_cogroup(spark: SparkSession, folder: str) -> DataFrame:
    """New users with auctions by a function over both sides of windows and persons."""
    return _cogrouped(_events(spark, folder))


@query(f"SELECT * FROM ({_FIRST_SQL}) {_CLOSED_DAYS_SQL}")
def new_user_auctions_cogroup_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same for days the watermark has closed, with both sides in one state."""
    persons = _persons(_events(spark, folder, streaming=True))
    auctions = _auctions(_events(spark, folder, streaming=True))
    both = windowed_cogroup(persons, auctions, "person_id", "event_time", f"{DAY} seconds", _first_persons, _NEW_USER_ROWS, at_once=True)
    return run_available_now(both)


# --- panes: early rows by the clock, and a final one ---------------------------------

PANE_SLICES = 4
# Rows of a slice that are worth a task of their own.
ROWS_PER_FILE = 25_000


def _landed_in_order(spark: SparkSession, rows: DataFrame, time: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """``rows`` as a stream of ``PANE_SLICES`` slices, cut along ``time``, one in each micro-batch; no time comes first.

    All tasks write a slice, as a file each. A micro-batch takes a fixed number of files, so every slice has as many:
    where one can't, for lack of rows, each is one file.
    """
    path, staged, cuts = scratch_path(spark, "landed"), scratch_path(spark, "staged"), [i / PANE_SLICES for i in range(1, PANE_SLICES)]
    rows.write.parquet(staged)  # what makes the rows is done once
    kept = spark.read.schema(rows.schema).parquet(staged)
    n, ends = kept.agg(F.count("*"), F.percentile_approx(micros(time), cuts)).first()
    passed = [F.coalesce((micros(time) >= end).cast("int"), F.lit(0)) for end in ends or []]
    files = max(1, min(parallelism(spark), n // (PANE_SLICES * rows_per_file)))
    placed = kept.withColumn("_slice", sum(passed, F.lit(0))).withColumn("_file", F.pmod(F.xxhash64(*rows.columns), F.lit(files)).cast("int"))
    if placed.select("_slice", "_file").distinct().count() < PANE_SLICES * files:
        files = 1
    for at in range(PANE_SLICES):
        here = placed.where(F.col("_slice") == at)
        here.repartitionById(files, "_file").select(*rows.columns).write.mode("append").parquet(path)
    landed = spark.read.schema(rows.schema).parquet(path)
    if files > 1 and len(landed.inputFiles()) != PANE_SLICES * files:  # a slice in two micro-batches would lose late rows
        raise RuntimeError(f"{path} should hold {PANE_SLICES} slices of {files} files each")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query(
    f"""SELECT *, window_start_us + {HOUR}000000 <= (SELECT max(epoch_us(e.ts)) FROM events e JOIN customer ON
    c_custkey = user_id WHERE event_type = 'view') AS final FROM ({_CAMPAIGN_SQL})"""
)
def campaign_panes_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Panes that fire four times a second until the watermark closes them, over several micro-batches, from their store."""
    views = _campaign_views(spark, folder)
    stream = _landed_in_order(spark, views, "event_time")
    panes = fired_fold(stream, "campaign_id", "event_time", f"{HOUR} seconds", COUNT_AND_LATEST, every_ms=250)
    path, config = scratch_path(spark, "panes"), StreamConfig(scratch_path(spark, "stream"), trigger_interval_ms=100)
    run_until(store_panes(panes, path, config), quiet(views.count(), batches=6))
    rows = read_panes(spark, path, ["window_start", "campaign_id"], panes.schema)
    return rows.select(micros("window_start").alias("window_start_us"), "campaign_id", "count", "last_update_us", "final")


@query(
    """SELECT ((user_id * 31 + event_id) % 16)::INTEGER AS region, 2 * count(*) AS "count", true AS final
    FROM events GROUP BY region"""
)
def region_clock_windows_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Sliding windows of two seconds over the time of processing, run until the clock has closed all of them."""
    regions = _events(spark, folder).select("ts", assign_region(F.col("user_id"), F.col("event_id")).alias("region"))
    counts = clock_fold(_landed_in_order(spark, regions, "ts"), "region", "2 seconds", slide="1 second")
    path, config = scratch_path(spark, "panes"), StreamConfig(scratch_path(spark, "stream"), trigger_interval_ms=100)
    run_until(store_panes(counts, path, config), nothing_open(regions.count()))
    rows = read_panes(spark, path, ["window_start", "region"], counts.schema)
    return rows.groupBy("region").agg(F.sum("count").alias("count"), F.min("final").alias("final"))


# --- regions -------------------------------------------------------------------

_REGION_SQL = f"""
SELECT (us // {DAY // 2}000000 - back) * {DAY // 2}000000 AS window_start_us,
       (us // {DAY // 2}000000 - back + 2) * {DAY // 2}000000 AS window_end_us,
       region::INTEGER AS region, count(*) AS "count"
FROM (SELECT epoch_us(ts) AS us, (user_id * 31 + event_id) % 16 AS region FROM events)
CROSS JOIN (SELECT unnest([0, 1]) AS back) GROUP BY 1, 2, 3
"""


def _region_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder).select(
        "ts", assign_region(F.col("user_id"), F.col("event_id")).alias("region")
    )
    return sliding_count(events, "region", "ts", DAY, DAY // 2)


@query(_REGION_SQL)
def region_sliding_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = _region_counts(spark, folder)
    return counts.select(
        micros("window_start").alias("window_start_us"),
        micros("window_end").alias("window_end_us"),
        "region",
        "count",
    )


# --- running counts ------------------------------------------------------------


def _counted_sql(where: str = "true") -> str:
    return f"""SELECT epoch_us(ts) AS event_us, event_id AS value,
        (event_id % {SHARDS})::VARCHAR AS shard, row_number() OVER
        (PARTITION BY event_id % {SHARDS} ORDER BY event_id) AS seq
        FROM events WHERE {where}"""


# What a counted number looks like when it leaves a query.
SHOWN_COUNT = (
    StructType()
    .add("event_us", "long")
    .add("value", "long")
    .add("shard", "string")
    .add("seq", "long")
)


def _shown_count(counted: DataFrame) -> DataFrame:
    return counted.select(micros("event_time").alias("event_us"), "value", "shard", "seq")


_TEXT_SQL = "SELECT value || ' - ' || shard || ' - ' || seq AS value FROM ({})"


def _shown_text(counted: DataFrame) -> DataFrame:
    text = counted_text(F.col("value"), F.col("shard"), F.col("seq"))
    return counted.select(text.alias("value"))


@query(_counted_sql())
def running_count_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_count(running_count(_numbers(_events(spark, folder)), "shard", "value"))


@query(_counted_sql())
def running_count_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The same with shards cut into buckets of about a hundred rows, as large ones are into larger ones."""
    numbers = _numbers(_events(spark, folder))
    return _shown_count(running_count(numbers, "shard", "value", rows_per_bucket=100))


@query(
    f"""SELECT event_type AS kind, (event_id % {SHARDS})::VARCHAR AS shard, row_number() OVER
    (PARTITION BY event_id % {SHARDS} ORDER BY event_type) AS seq FROM events"""
)
def running_count_equals(spark: SparkSession, folder: str) -> DataFrame:
    """A few values that hold most rows each: counted before they are numbered, in stretches of a hundred."""
    shard = F.pmod(F.col("event_id"), F.lit(SHARDS)).cast("string").alias("shard")
    kinds = _events(spark, folder).select(F.col("event_type").alias("kind"), shard)
    return running_count_of_equals(kinds, "shard", "kind", stretch=100)


@query(_TEXT_SQL.format(_counted_sql()))
def running_count_text(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_text(running_count(_numbers(_events(spark, folder)), "shard", "value"))


@query(_TEXT_SQL.format(_counted_sql("event_id % 2 = 0")))
def even_running_count(spark: SparkSession, folder: str) -> DataFrame:
    even = _numbers(_events(spark, folder)).where(divisible_by(F.col("value"), 2))
    return _shown_text(running_count(even, "shard", "value"))


@query(_counted_sql("event_id % 5 = 0"))
def mod5_running_count(spark: SparkSession, folder: str) -> DataFrame:
    fives = _numbers(_events(spark, folder)).where(divisible_by(F.col("value"), 5))
    return _shown_count(running_count(fives, "shard", "value"))


@query(_counted_sql())
def running_count_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered micro-batch by micro-batch, in order within each."""
    numbers = _numbers(_events(spark, folder, streaming=True))
    path = scratch_path(spark, "counted")
    config = StreamConfig(scratch_path(spark, "stream"), available_now=True)
    count_stream(numbers, "shard", "value", path, config, then=_shown_count).awaitTermination()
    return read_counted(spark, path, SHOWN_COUNT)


@query(
    f"""WITH e AS (SELECT event_id, (event_id % {STREAM_SHARDS})::VARCHAR AS shard FROM events)
    SELECT 'row' AS kind, shard, event_id AS number FROM e UNION ALL
    SELECT 'count', shard, row_number() OVER (PARTITION BY shard ORDER BY event_id) FROM e"""
)
def stateful_count_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered as rows arrive: every row comes back once, and so does every number of a shard."""
    events = _events(spark, folder, streaming=True)
    shard = F.pmod(F.col("event_id"), F.lit(STREAM_SHARDS)).cast("string").alias("shard")
    counted = stateful_count(events.select("event_id", shard), "shard")
    rows = run_available_now(counted)
    shown = lambda kind, column: rows.select(F.lit(kind).alias("kind"), "shard", F.col(column).alias("number"))
    return shown("row", "event_id").union(shown("count", "seq"))


@query(
    f"SELECT event_us, value, shard FROM ({_counted_sql()}) WHERE seq % {NTH} = 0",
    key="every_nth",
)
def every_nth_row(spark: SparkSession, folder: str) -> DataFrame:
    kept = every_nth(_numbers(_events(spark, folder)), NTH, "shard", "value")
    return kept.select(micros("event_time").alias("event_us"), "value", "shard")


@query(
    f"""SELECT value, ((value - lowest) % {SHARDS})::VARCHAR AS shard FROM (
    SELECT lowest, unnest(range(lowest, highest + 1)) AS value FROM
    (SELECT min(o_orderkey) AS lowest, max(o_orderkey) AS highest FROM orders))""",
    key="interval_sequence",
)
def interval_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Every number from the lowest to the highest order key."""
    ends = read_table(spark, folder, "orders").agg(
        F.min("o_orderkey").alias("lowest"), F.max("o_orderkey").alias("highest")
    ).first()
    return interval_sequence(spark, ends["lowest"], ends["highest"], SHARDS)


# --- text ----------------------------------------------------------------------


def _customer_text(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer").select(
        F.concat_ws(" ", "c_name", "c_mktsegment").alias("value")
    )


@query("SELECT lower(c_name || ' ' || c_mktsegment) AS value FROM customer")
def text_lowercase(spark: SparkSession, folder: str) -> DataFrame:
    return _customer_text(spark, folder).select(lowercase(F.col("value")).alias("value"))


@query("SELECT text || ' - appended text' AS value FROM documents")
def text_append(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select(
        append_text(F.col("text")).alias("value")
    )


@query(
    """SELECT 'Received: ' || c_name AS value FROM customer
    WHERE CAST(substr(c_name, 11) AS BIGINT) % 2 = 0"""
)
def filter_prefix(spark: SparkSession, folder: str) -> DataFrame:
    names = read_table(spark, folder, "customer").select(F.col("c_name").alias("value"))
    number = strict_long(number_after(F.col("value")))
    return names.where(divisible_by(number, 2)).select(
        prefix_text(F.col("value")).alias("value")
    )


@query(
    """SELECT CASE WHEN c_custkey % 3 = 2 THEN c_name || chr(13) ELSE c_name END AS value
    FROM customer"""
)
def lines_crlf(spark: SparkSession, folder: str) -> DataFrame:
    """Names that end in none, one or two carriage returns lose one."""
    returns = F.repeat(F.lit("\r"), F.pmod(F.col("c_custkey"), F.lit(3)).cast("int"))
    lines = read_table(spark, folder, "customer").select(
        F.concat("c_name", returns).alias("value")
    )
    return lines.select(without_cr(F.col("value")).alias("value"))


# --- parsers -------------------------------------------------------------------


def _lines(df: DataFrame, *fields, delimiter: str = ",") -> DataFrame:
    return df.select(F.concat_ws(delimiter, *fields).alias("value"))


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


@query(
    f"""SELECT c_custkey * 1000 AS "timestamp", c_custkey AS person_id, c_name AS name,
    c_name || '@x.org' AS email, c_mktsegment AS city, n_name AS country, 'P' || n_regionkey AS
    province, c_nationkey::VARCHAR AS zipcode, 'http://x/' || c_custkey AS homepage,
    '1111' AS creditcard, c_custkey * 1000000 AS event_us, {AS_OF_MS}::BIGINT AS
    ingestion_timestamp FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    key="parse_persons",
)
def parse_persons_lines(spark: SparkSession, folder: str) -> DataFrame:
    customers = read_table(spark, folder, "customer")
    nations = read_table(spark, folder, "nation")
    people = enrich(customers, nations.withColumnRenamed("n_nationkey", "c_nationkey"),
                    "c_nationkey")
    lines = _lines(
        people,
        _text(F.col("c_custkey") * 1000),
        _text("c_custkey"),
        "c_name",
        F.concat("c_name", F.lit("@x.org")),
        "c_mktsegment",
        "n_name",
        F.concat(F.lit("P"), _text("n_regionkey")),
        _text("c_nationkey"),
        F.concat(F.lit("http://x/"), _text("c_custkey")),
        F.lit("1111"),
    )
    parsed = parse_persons(lines, ingest_time=AS_OF)
    return parsed.withColumn("event_us", micros("event_time")).drop("event_time")


@query(
    f"""SELECT epoch_us(o_orderdate) // 1000 AS "timestamp", o_orderkey AS auction_id,
    o_orderkey * 7 AS item_id, o_custkey AS person_id, o_totalprice AS initial_price,
    substr(o_orderpriority, 1, 1)::BIGINT AS category_id, epoch_us(o_orderdate) // 1000 AS
    "start", epoch_us(o_orderdate) // 1000 + 3600000 AS "end", epoch_us(o_orderdate) AS event_us,
    {AS_OF_MS}::BIGINT AS ingestion_timestamp FROM orders""",
    key="parse_auctions",
)
def parse_auctions_lines(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    start = epoch_ms(F.col("o_orderdate").cast("timestamp"))
    lines = _lines(
        orders,
        _text(start),
        _text("o_orderkey"),
        _text(F.col("o_orderkey") * 7),
        _text("o_custkey"),
        _text("o_totalprice"),
        F.substring("o_orderpriority", 1, 1),
        _text(start),
        _text(start + 3_600_000),
    )
    parsed = parse_auctions(lines, ingest_time=AS_OF)
    return parsed.withColumn("event_us", micros("event_time")).drop("event_time")


def _ad_lines(spark: SparkSession, folder: str, numbered: bool, events: DataFrame | None = None) -> DataFrame:
    events = _events(spark, folder) if events is None else events
    front = [_text("event_id")] if numbered else []
    return _lines(
        events,
        *front,
        F.concat(F.lit("u"), _text("user_id")),
        F.concat(F.lit("p"), _text("event_id")),
        _text("user_id"),
        F.lit("poster"),
        "event_type",
        _text(epoch_ms(F.col("ts"))),
        F.lit("192.0.2.1"),
    )


_AD_SQL = """SELECT {front} 'u' || user_id AS user_id, 'p' || event_id AS page_id,
    user_id::VARCHAR AS ad_id, 'poster' AS ad_type, event_type,
    epoch_us(ts) // 1000 AS event_ms, '192.0.2.1' AS ip_address FROM events"""


def _shown_ads(ads: DataFrame) -> DataFrame:
    return ads.withColumn("event_ms", epoch_ms(F.col("event_time"))).drop("event_time")


@query(_AD_SQL.format(front=""), key="parse_ad_events")
def parse_ad_event_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_ads(parse_ad_events(_ad_lines(spark, folder, numbered=False)))


@query(_AD_SQL.format(front="event_id AS id,"), key="parse_numbered_ad_events")
def parse_numbered_ad_event_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_ads(parse_ad_events(_ad_lines(spark, folder, numbered=True), numbered=True))


@query(
    "SELECT user_id AS lat, event_id AS lng, event_type AS category FROM events",
    key="parse_geo_events",
)
def parse_geo_event_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(
        _events(spark, folder), _text("user_id"), _text("event_id"), F.lit("x"), "event_type"
    )
    return parse_geo_events(lines)


def _number_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(
        _events(spark, folder),
        _text(epoch_ms(F.col("ts"))),
        _text("event_id"),
        delimiter="#",
    )


@query(
    "SELECT epoch_us(ts) // 1000 AS event_ms, event_id AS value FROM events",
    key="parse_timestamped_numbers",
)
def parse_timestamped_number_lines(spark: SparkSession, folder: str) -> DataFrame:
    numbers = parse_timestamped_numbers(_number_lines(spark, folder))
    return numbers.select(epoch_ms(F.col("event_time")).alias("event_ms"), "value")


@query(
    """WITH l AS (SELECT event_id, epoch_us(ts) // 1000 AS ms,
        CASE WHEN event_id % 97 = 0 THEN event_id // 97 % 4 ELSE 4 END AS kind FROM events)
    SELECT CASE kind WHEN 0 THEN ms || '' WHEN 1 THEN '#' || event_id
        WHEN 2 THEN 'x#' || event_id WHEN 3 THEN ms || '#' || event_id || '#3'
        ELSE ms || '#' || event_id END AS value,
        CASE kind WHEN 4 THEN ms END AS event_ms, CASE kind WHEN 4 THEN event_id END AS number,
        CASE kind WHEN 0 THEN 'no delimiter' WHEN 1 THEN 'event_time: not a time in milliseconds'
        WHEN 2 THEN 'event_time: not a time in milliseconds'
        WHEN 3 THEN 'not exactly 2 fields' END AS reason FROM l"""
)
def parse_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Every 97th line is spoilt, in one of four ways; all lines come back with a verdict."""
    ms, number = _text(epoch_ms(F.col("ts"))), _text("event_id")
    good = F.concat(ms, F.lit("#"), number)
    kind = F.floor(F.col("event_id") / 97) % 4
    line = (
        F.when(F.col("event_id") % 97 != 0, good)
        .when(kind == 0, ms)
        .when(kind == 1, F.concat(F.lit("#"), number))
        .when(kind == 2, F.concat(F.lit("x#"), number))
        .otherwise(F.concat(good, F.lit("#3")))
    )
    lines = _events(spark, folder).select(line.alias("value"))
    tagged = parse_timestamped_numbers(lines, mode="tagged")
    return tagged.withColumn("event_ms", epoch_ms(F.col("event_time"))).drop("event_time")


# --- reports -------------------------------------------------------------------

_LATENCY_SQL = f"{AS_OF_MS} - event_us // 1000 AS latency_ms"


@query(f"SELECT {_LATENCY_SQL}, value FROM ({_counted_sql()})")
def number_latency(spark: SparkSession, folder: str) -> DataFrame:
    counted = running_count(_numbers(_events(spark, folder)), "shard", "value")
    return number_latency_report(counted, as_of=AS_OF)


@query(f"SELECT {_LATENCY_SQL}, value, shard, seq FROM ({_counted_sql()})")
def number_latency_full(spark: SparkSession, folder: str) -> DataFrame:
    counted = running_count(_numbers(_events(spark, folder)), "shard", "value")
    return number_latency_report(counted, only_latency=False, as_of=AS_OF)


@query(
    f"""SELECT campaign_id, "count", {AS_OF_MS} - last_update_us // 1000 AS latency_ms,
    window_start_us // 1000 AS window_ms FROM ({_CAMPAIGN_SQL})"""
)
def campaign_latency(spark: SparkSession, folder: str) -> DataFrame:
    return campaign_latency_report(_campaign_counts(spark, folder), as_of=AS_OF)


@query(
    f"""SELECT {AS_OF_MS}::BIGINT AS now_ms, {AS_OF_MS} - window_evicting AS eviction_latency_ms,
    {AS_OF_MS} - auction_creation AS auction_latency_ms,
    {AS_OF_MS} - person_creation AS person_latency_ms, person_id, person_name
    FROM ({_FIRST_SQL})"""
)
def new_user_latency(spark: SparkSession, folder: str) -> DataFrame:
    return new_user_latency_report(_new_users(spark, folder), as_of=AS_OF)


@query(
    f'SELECT {AS_OF_MS}::BIGINT AS now_ms, region, "count" FROM ({_REGION_SQL})',
    key="region_report",
)
def region_latency(spark: SparkSession, folder: str) -> DataFrame:
    return region_report(_region_counts(spark, folder), as_of=AS_OF)


# --- whole jobs, from raw lines to the report --------------------------------------


def _text_lines(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The lines of ``df`` from files they are first written to."""
    path = scratch_path(spark, "lines")
    df.write.text(path)
    return text_lines(spark, path)


@query(ORACLES["text_lowercase"])
def lowercase_job(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.lowercase_text(_text_lines(spark, _customer_text(spark, folder)))


@query("SELECT c_name || ' ' || c_mktsegment || ' - appended text' AS value FROM customer")
def append_job(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.appended_text(_text_lines(spark, _customer_text(spark, folder)))


@query(ORACLES["filter_prefix"])
def filter_prefix_job(spark: SparkSession, folder: str) -> DataFrame:
    names = read_table(spark, folder, "customer").select(F.col("c_name").alias("value"))
    return jobs.even_lines(_text_lines(spark, names))


@query(
    f"""WITH l AS (SELECT event_type AS value, CAST('0x' || substr(md5(event_type), 1, 13) AS BIGINT) AS place FROM events
        UNION ALL SELECT c_name, CAST('0x' || substr(md5(c_name), 1, 13) AS BIGINT) FROM customer)
    SELECT value || ' - ' || place % {SHARDS} || ' - ' ||
    row_number() OVER (PARTITION BY place % {SHARDS} ORDER BY place, value) AS value FROM l"""
)
def count_text_job(spark: SparkSession, folder: str) -> DataFrame:
    """A few lines that come very often, and many that come once."""
    often = _events(spark, folder).select(F.col("event_type").alias("value"))
    lines = often.union(read_table(spark, folder, "customer").select("c_name"))
    return jobs.counted_lines(_text_lines(spark, lines), SHARDS).batch()


_INTERVAL_SQL = f"""SELECT value || ' - ' || (value - lowest) % {SHARDS} || ' - ' || row_number() OVER
    (PARTITION BY (value - lowest) % {SHARDS} ORDER BY value) AS value FROM (
    SELECT lowest, unnest(range(lowest, highest + 1)) AS value FROM
    (SELECT min(o_orderkey) AS lowest, max(o_orderkey) AS highest FROM orders)) {{}}"""


def _interval(spark: SparkSession, folder: str) -> tuple[int, int]:
    ends = read_table(spark, folder, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return ends[0], ends[1]


@query(_INTERVAL_SQL.format(""))
def count_sequence_job(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.counted_numbers(interval_sequence(spark, *_interval(spark, folder), SHARDS)).batch()


@query(_INTERVAL_SQL.format("WHERE value % 2 = 0"))
def count_even_sequence_job(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.counted_even_numbers(interval_sequence(spark, *_interval(spark, folder), SHARDS)).batch()


@query(_INTERVAL_SQL.format(""))
def count_sequence_stream_job(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of three micro-batches, run until all numbers are through."""
    start, end = _interval(spark, folder)
    path, config = scratch_path(spark, "counted"), StreamConfig(scratch_path(spark, "stream"), trigger_interval_ms=0)
    numbers = interval_sequence_stream(spark, start, end, SHARDS, (end - start) // 3 + 1)
    run_to_end(lambda: jobs.counted_numbers(numbers).stream(path, config), end)
    return read_counted(spark, path, StructType([StructField("value", StringType())]))


_NUMBER_JOB_SQL = f"""SELECT {_LATENCY_SQL}, value, shard, seq FROM ({{}}) WHERE seq % {NTH} = 0"""


@query(_NUMBER_JOB_SQL.format(_counted_sql()))
def number_latency_job(spark: SparkSession, folder: str) -> DataFrame:
    lines = _text_lines(spark, _number_lines(spark, folder))
    return jobs.number_latencies(lines, SHARDS, only_latency=False, every=NTH, as_of=AS_OF).batch()


@query(_NUMBER_JOB_SQL.format(_counted_sql("event_id % 5 = 0")))
def number_latency_mod5_job(spark: SparkSession, folder: str) -> DataFrame:
    lines = _text_lines(spark, _number_lines(spark, folder))
    return jobs.number_latencies(lines, SHARDS, only_latency=False, every=NTH, multiples_of=5, as_of=AS_OF).batch()


_RUNS_SQL = f"""WITH v AS (SELECT event_id % {SHARDS} AS shard, epoch_us(ts) // 1000 AS ms, row_number() OVER
        (PARTITION BY event_id % {SHARDS} ORDER BY event_id) AS seq FROM events WHERE event_type = '{COUNTED_EVENT}')
    SELECT shard || '-' || (seq - 1) // 10 AS campaign_id, count(*) AS "count", {AS_OF_MS} - max(ms) AS latency_ms,
    ms // {HOUR * 1000} * {HOUR * 1000} AS window_ms FROM v GROUP BY 1, 4"""


@query(_RUNS_SQL)
def campaign_runs_job(spark: SparkSession, folder: str) -> DataFrame:
    lines = _ad_lines(spark, folder, numbered=True)
    return jobs.campaign_latencies(lines, None, f"{HOUR} seconds", as_of=AS_OF, shards=SHARDS)


@query(f"{_RUNS_SQL} HAVING window_ms + {HOUR * 1000} <= (SELECT max(ms) FROM v)")
def campaign_runs_stream_job(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a lasting stream of four micro-batches: the windows that the watermark has closed."""
    events = _landed_in_order(spark, _events(spark, folder).select("event_id", "ts", "user_id", "event_type"), "ts")
    path, config = scratch_path(spark, "runs"), StreamConfig(scratch_path(spark, "stream"), trigger_interval_ms=100)
    lines = _ad_lines(spark, folder, True, events)
    query = jobs.campaign_run_stream(lines, path, config, f"{HOUR} seconds", shards=SHARDS, as_of=AS_OF)
    query.processAllAvailable()
    query.stop()
    return read_closed(spark, path, "campaign_id string, count bigint, latency_ms bigint, window_ms bigint")


@query(
    f"""SELECT {AS_OF_MS}::BIGINT AS now_ms, ((user_id * 31 + event_id) % 16)::INTEGER AS region,
    count(*) AS "count" FROM events CROSS JOIN (SELECT unnest([0, 1]) AS back)
    GROUP BY region, back"""
)
def region_counts_job(spark: SparkSession, folder: str) -> DataFrame:
    """Windows over the time of processing, which is fixed here: all rows are in the same two."""
    lines = _lines(
        _events(spark, folder), _text("user_id"), _text("event_id"), F.lit("x"), "event_type"
    )
    return region_report(jobs.region_counts(lines, at=AS_OF), as_of=AS_OF)


@query(ORACLES["new_user_latency"])
def new_users_job(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    ms, user = _text(epoch_ms(F.col("ts"))), _text("user_id")
    blanks = [F.lit("x")] * 7
    persons = _lines(
        events.where(F.col("event_type") == "signup"),
        ms, user, F.concat(F.lit("user "), user), *blanks,
    )
    auctions = _lines(
        events.where(F.col("event_type") == "purchase"),
        ms, _text("event_id"), F.lit("5"), user, _text("value"), F.lit("3"), ms, ms,
    )
    return jobs.new_user_latencies(persons, auctions, f"{DAY} seconds", as_of=AS_OF)


@query(ORACLES["campaign_latency"])
def campaign_counts_job(spark: SparkSession, folder: str) -> DataFrame:
    campaigns = _campaigns(spark, folder).withColumn("ad_id", _text("ad_id"))
    lines = _ad_lines(spark, folder, numbered=False)
    return jobs.campaign_latencies(lines, campaigns, f"{HOUR} seconds", as_of=AS_OF)
