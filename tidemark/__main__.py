"""Run a ready-made job: ``python -m tidemark <job> --input <files> --path <folder>``."""

from __future__ import annotations

import argparse
import posixpath
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.campaigns import CAMPAIGN_WINDOW
from tidemark.operators.new_users import STREAM_SALTS
from tidemark.plans import jobs
from tidemark.plans.job import Job, job
from tidemark.session import build_session
from tidemark.sinks import good_lines, store_panes, upsert_latest, write_csv, write_text
from tidemark.sources import (
    interval_sequence,
    interval_sequence_stream,
    kafka_lines,
    parse_ad_events,
    parse_auctions,
    parse_geo_events,
    parse_persons,
    parse_timestamped_numbers,
    run_to_end,
    text_lines,
)
from tidemark.sources.sequence import ROWS_PER_BATCH
from tidemark.streaming.config import CHECKPOINT_INTERVAL_MS, STATE_BACKENDS, StreamConfig

TEXT_JOBS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "lowercase": jobs.lowercase_text,
    "append-text": jobs.appended_text,
    "filter-prefix": jobs.even_lines,
}
SEQUENCE_JOBS = {"count-sequence": jobs.counted_numbers, "count-even-sequence": jobs.counted_even_numbers}
NUMBER_JOBS = {"number-latency": None, "number-latency-mod5": 5}
OTHER_JOBS = ("region-counts", "new-users", "campaign-counts")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("job", choices=[*TEXT_JOBS, "count-text", *SEQUENCE_JOBS, *NUMBER_JOBS, *OTHER_JOBS])
    p.add_argument("--path", required=True, help="folder the results go to")
    source = p.add_argument_group("source")
    source.add_argument("--input", help="file, folder or glob with lines")
    source.add_argument("--auctions", help="the auction lines of new-users")
    source.add_argument("--campaigns", help="parquet table with ad_id and campaign_id")
    source.add_argument("--topic", help="read lines from this Kafka topic instead")
    source.add_argument("--auctions-topic", help="the Kafka topic of the auctions of new-users")
    source.add_argument("--starting-offsets", help="earliest, latest or Kafka's JSON of offsets")
    source.add_argument("--ignore-data-loss", action="store_true", help="go on if Kafka has dropped rows")
    source.add_argument("--max-offsets-per-trigger", type=int)
    source.add_argument("--servers", default="localhost:9092")
    source.add_argument("--groupid", default="defaultGroupID")
    source.add_argument("--delimiter", default="\n")
    source.add_argument("--max-number", type=int, default=100_000, help="end of a sequence")
    source.add_argument("--rows-per-batch", type=int, default=ROWS_PER_BATCH, help="of a sequence as a stream")
    source.add_argument("--max-files-per-trigger", type=int)
    source.add_argument("--rejects", help="folder for the verdicts on all lines: malformed ones no longer end the job")
    work = p.add_argument_group("job")
    work.add_argument("--shards", type=int, default=jobs.SHARDS)
    work.add_argument("--window-ms", type=int, help="width of tumbling windows")
    work.add_argument("--window-seconds", type=int, default=60, help="size of sliding windows")
    work.add_argument("--slide-seconds", type=int, default=30)
    work.add_argument("--delay", default="0 seconds", help="how late a row may come")
    work.add_argument("--missing", default="error", choices=["error", "drop", "keep"])
    work.add_argument("--evict-now", action="store_true", help="new-users: windows count as evicted by the clock")
    work.add_argument("--salts", type=int, default=STREAM_SALTS, help="new-users: slices of a person in a stream")
    work.add_argument("--full", action="store_true", help="report shard and count too")
    work.add_argument("--every", type=int, default=1, help="report every n-th row only")
    stream = p.add_argument_group("stream")
    stream.add_argument("--stream", action="store_true", help="run until stopped")
    stream.add_argument("--available-now", action="store_true", help="stream what is there, stop")
    stream.add_argument("--checkpoint", help="folder for positions and state")
    stream.add_argument("--checkpoint-interval-ms", type=int, default=CHECKPOINT_INTERVAL_MS)
    stream.add_argument("--trigger-interval-ms", type=int, default=0,
                        help="campaign-counts as a stream: store running reports this often")
    stream.add_argument("--fire-every-ms", type=int,
                        help="campaign-counts: a store of panes that fire this often by the clock (0: not early) and end with a final row")
    stream.add_argument("--by-clock", action="store_true",
                        help="region-counts: a store of windows that the clock closes, with or without input")
    stream.add_argument("--backend", default="rocksdb", choices=STATE_BACKENDS)
    stream.add_argument("--full-snapshots", action="store_true")
    return p


def _is_stream(args: argparse.Namespace) -> bool:
    return args.stream or args.available_now


def _config(args: argparse.Namespace) -> StreamConfig | None:
    if not _is_stream(args):
        return None
    if not args.checkpoint:
        raise SystemExit("a stream needs --checkpoint")
    return StreamConfig(
        args.checkpoint,
        args.trigger_interval_ms or args.checkpoint_interval_ms,
        args.available_now,
        args.backend,
        not args.full_snapshots,
    )


def _lines(args: argparse.Namespace, path: str | None = None, topic: str | None = None):
    """Lines of a topic if one is given, else of files; by default of the job's main input."""
    if path is None and topic is None:
        path, topic = args.input, args.topic

    def read(spark: SparkSession) -> DataFrame:
        if topic:
            return kafka_lines(
                spark, topic, args.servers, args.groupid, _is_stream(args), args.max_offsets_per_trigger,
                args.starting_offsets, not args.ignore_data_loss,
            )
        if not path:
            raise SystemExit("--input or --topic is needed")
        return text_lines(spark, path, args.delimiter, _is_stream(args), args.max_files_per_trigger)

    return read


def _judged(args: argparse.Namespace, config: StreamConfig | None, parse, name: str, *place):
    """The lines of ``_lines``; with ``--rejects`` the good ones of them, all verdicts going to its folder ``name``."""
    read = _lines(args, *place)
    if not args.rejects:
        return read
    own = replace(config, checkpoint=f"{config.checkpoint}-{name}-verdicts") if config else None
    path = posixpath.join(args.rejects, name)
    return lambda spark: good_lines(read(spark), parse, path, own, args.max_files_per_trigger)


def _count_sink(make: Callable[[DataFrame], jobs.Counting], args: argparse.Namespace, config, form: str):
    """Numbered rows as files: of a batch in ``--path``, of a stream in its ``rows`` folder."""

    def sink(df: DataFrame):
        counting = make(df)
        if config is None:
            rows = counting.batch()
            return write_text(rows, args.path, None) if form == "text" else write_csv(rows, args.path, None)
        return counting.stream(args.path, config, form)

    return sink


def _lasting(config: StreamConfig | None) -> StreamConfig:
    """The settings of a query with timers, which must run until it is stopped."""
    if config is None or config.available_now:
        raise SystemExit("panes that timers close need --stream without --available-now")
    return config


def _width(args: argparse.Namespace, default: str) -> str:
    return f"{args.window_ms} milliseconds" if args.window_ms else default


def build(args: argparse.Namespace) -> Job:
    """The job the arguments describe."""
    config = _config(args)
    name = args.job
    if name in TEXT_JOBS:
        text_sink = lambda df: write_text(df, args.path, config)
        return job(_lines(args), TEXT_JOBS[name], sink=text_sink)
    if name == "count-text":
        return job(_lines(args), sink=_count_sink(lambda df: jobs.counted_lines(df, args.shards), args, config, "text"))
    if name in SEQUENCE_JOBS:
        sink = _count_sink(SEQUENCE_JOBS[name], args, config, "text")
        if config is None:
            return job(lambda spark: interval_sequence(spark, 0, args.max_number, args.shards), sink=sink)
        return job(
            lambda spark: interval_sequence_stream(spark, 0, args.max_number, args.shards, args.rows_per_batch),
            sink=lambda df: run_to_end(lambda: sink(df), args.max_number),
        )

    def csv_sink(df: DataFrame):
        return write_csv(df, args.path, config)

    if name in NUMBER_JOBS:
        make = lambda df: jobs.number_latencies(
            df, args.shards, not args.full, args.every, NUMBER_JOBS[name]
        )
        return job(_judged(args, config, parse_timestamped_numbers, "numbers"), sink=_count_sink(make, args, config, "csv"))
    if name == "region-counts" and args.by_clock:
        panes = lambda df: jobs.region_panes(df, args.window_seconds, args.slide_seconds)
        lasting = _lasting(config)
        return job(_judged(args, config, parse_geo_events, "geo-events"), panes, sink=lambda df: store_panes(df, args.path, lasting))
    if name == "region-counts":
        report = lambda df: jobs.region_latencies(
            df, args.window_seconds, args.slide_seconds
        )
        return job(_judged(args, config, parse_geo_events, "geo-events"), report, sink=csv_sink)
    if name == "new-users":
        if bool(args.input) == bool(args.topic) or bool(args.auctions) == bool(args.auctions_topic):
            raise SystemExit("new-users needs --input or --topic for persons, and --auctions or --auctions-topic")
        width = _width(args, jobs.NEW_USER_WINDOW)

        def report(persons: DataFrame) -> DataFrame:
            auctions = _judged(args, config, parse_auctions, "auctions", args.auctions, args.auctions_topic)(persons.sparkSession)
            evicted = None if args.evict_now else "window end"
            return jobs.new_user_latencies(persons, auctions, width, args.delay, evicted_at=evicted, salts=args.salts)

        return job(_judged(args, config, parse_persons, "persons"), report, sink=csv_sink)

    width = _width(args, CAMPAIGN_WINDOW)
    events = _judged(args, config, partial(parse_ad_events, numbered=not args.campaigns), "ad-events")
    if args.fire_every_ms is not None:
        lasting = _lasting(config)
        if not args.campaigns:
            raise SystemExit("panes need --campaigns")

        def panes(lines: DataFrame) -> DataFrame:
            campaigns = lines.sparkSession.read.parquet(args.campaigns)
            return jobs.campaign_panes(lines, campaigns, width, args.delay, args.missing, args.fire_every_ms)

        return job(events, panes, sink=lambda df: store_panes(df, args.path, lasting))
    if config is not None and not args.campaigns:
        return job(
            events,
            sink=lambda df: jobs.campaign_run_stream(df, args.path, config, width, args.delay, args.shards, form="csv"),
        )

    def counts(lines: DataFrame) -> DataFrame:
        campaigns = lines.sparkSession.read.parquet(args.campaigns) if args.campaigns else None
        return jobs.campaign_latencies(lines, campaigns, width, args.delay, args.missing, shards=args.shards)

    # Running results of a stream are kept as the newest report row of each campaign and window.
    early = args.trigger_interval_ms and config
    sink = (lambda df: upsert_latest(df, args.path, config, ["campaign_id", "window_ms"])) if early else csv_sink
    return job(events, counts, sink=sink)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    work = build(args)
    spark = spark or build_session(f"tidemark {args.job}")
    query = work.run(spark)
    if query is not None and args.rejects and not args.available_now:
        spark.streams.awaitAnyTermination()  # the job's query or that of the verdicts
    elif query is not None:
        query.awaitTermination()


if __name__ == "__main__":
    main()
