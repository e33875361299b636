"""Streams against their batch twins, late rows, restarts."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators.counting import run_id, running_count
from tidemark.operators.new_users import new_user_auction_pairs, new_users_with_auctions
from tidemark.operators.windows import event_time, sliding_count, windowed_count
from tidemark.sinks import compact_latest, read_latest, upsert_latest, write_csv, write_text
from tidemark.sources.sequence import interval_sequence, interval_sequence_stream, run_to_end
from tidemark.streaming.config import StreamConfig
from tidemark.streaming.counting import count_stream, read_counted, stateful_count
from tidemark.streaming.progress import progress_report
from tidemark.streaming.run import run_available_now

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
FILES = 4


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


@pytest.fixture(scope="module")
def slices(spark, events):
    """The events in time order, cut into equal slices."""
    n = events.count()
    return [
        events.where((F.col("event_id") >= i * n // FILES) & (F.col("event_id") < (i + 1) * n // FILES))
        for i in range(FILES)
    ]


class Landing:
    """A folder files arrive in, in order, and the stream that reads it one file at a time."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema

    def add(self, *frames):
        for frame in frames:
            frame.coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self, time=None, delay="0 seconds"):
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
        df = reader.parquet(self.folder)
        return event_time(df, time, delay) if time else df


@pytest.fixture()
def landing(spark, tmp_path, events):
    return Landing(spark, tmp_path / "in", events.schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def config(tmp_path, **more):
    return StreamConfig(str(tmp_path / "checkpoint"), available_now=True, **more)


def daily(df):
    few = df.where("event_type = 'view'").withColumn("user_id", F.col("user_id") % 5)
    return windowed_count(few, "user_id", "ts", "1 day")


@pytest.mark.parametrize("backend", ["memory", "rocksdb"])
def test_tumbling_counts_of_closed_windows(landing, slices, events, tmp_path, backend):
    landing.add(*slices)
    got = run_available_now(
        daily(landing.stream("ts")), str(tmp_path / "out"), config(tmp_path, state_backend=backend)
    )
    last = events.where("event_type = 'view'").agg(F.max("ts")).first()[0]
    want = daily(events).where(F.col("window_start") + F.expr("INTERVAL 1 DAY") <= F.lit(last))
    assert rows(got) == rows(want)
    assert got.count() > 0


def test_sliding_counts_of_closed_windows(landing, slices, events, tmp_path):
    def counts(df):
        return sliding_count(df, "event_type", "ts", 7200, 3600)

    landing.add(*slices)
    got = run_available_now(counts(landing.stream("ts")), str(tmp_path / "out"), config(tmp_path))
    last = events.agg(F.max("ts")).first()[0]
    assert rows(got) == rows(counts(events).where(F.col("window_end") <= F.lit(last)))


def test_early_results_survive_a_restart(landing, slices, events, spark, tmp_path):
    store, keys = str(tmp_path / "store"), ["window_start", "user_id"]
    for part in (slices[:2], slices[2:]):
        landing.add(*part)
        counts = daily(landing.stream("ts"))
        query = upsert_latest(counts, store, config(tmp_path))
        query.awaitTermination()
    latest = read_latest(spark, store, keys, counts.schema).select(*counts.columns)
    assert rows(latest) == rows(daily(events))
    assert spark.read.parquet(store).count() > latest.count()


def test_a_compacted_store_takes_over(landing, slices, events, spark, tmp_path):
    first, second, keys = str(tmp_path / "one"), str(tmp_path / "two"), ["window_start", "user_id"]
    landing.add(*slices[:3])
    counts = daily(landing.stream("ts"))
    upsert_latest(counts, first, config(tmp_path)).awaitTermination()
    compact_latest(spark, first, second, keys)
    assert rows(read_latest(spark, first, keys)) == rows(read_latest(spark, second, keys))
    # A replay of the last micro-batch goes to the new store, and so do later ones.
    forget_last_commit(tmp_path / "checkpoint" / "commits")
    landing.add(slices[3])
    upsert_latest(daily(landing.stream("ts")), second, config(tmp_path)).awaitTermination()
    latest = read_latest(spark, second, keys, counts.schema).select(*counts.columns)
    assert rows(latest) == rows(daily(events))


def _late(spark, tmp_path, *batches):
    schema = "k string, t timestamp"
    frames = [
        spark.createDataFrame([("a", START + timedelta(seconds=s))], schema) for s in batches
    ]
    landing = Landing(spark, tmp_path / "in", frames[0].schema)
    landing.add(*frames)
    counts = windowed_count(landing.stream("t"), "k", "t", "10 seconds")
    query = upsert_latest(counts, str(tmp_path / "store"), config(tmp_path))
    query.awaitTermination()
    latest = read_latest(spark, str(tmp_path / "store"), ["window_start", "k"])
    starts = latest.select(F.unix_seconds("window_start") - int(START.timestamp()))
    return sorted(r[0] for r in starts.collect()), progress_report(query)


def test_late_row_one_batch_behind_is_kept(spark, tmp_path):
    starts, report = _late(spark, tmp_path, 25, 3)
    assert starts == [0, 20]
    assert sum(p["late_rows_dropped"] for p in report) == 0


def test_late_row_two_batches_behind_is_dropped(spark, tmp_path):
    starts, report = _late(spark, tmp_path, 25, 26, 3)
    assert starts == [20]
    assert sum(p["late_rows_dropped"] for p in report) == 1
    assert all(p["duration_ms"] is not None for p in report)


def people(df):
    return df.where("event_type = 'signup'").select(
        F.unix_millis("ts").alias("timestamp"),
        F.col("user_id").alias("person_id"),
        F.concat(F.lit("user "), F.col("event_id").cast("string")).alias("name"),
        F.col("ts").alias("event_time"),
        F.lit(0).cast("bigint").alias("ingestion_timestamp"),
    )


def sales(df):
    return df.where("event_type = 'purchase'").select(
        F.unix_millis("ts").alias("timestamp"),
        F.col("event_id").alias("auction_id"),
        F.col("user_id").alias("person_id"),
        F.col("ts").alias("event_time"),
        F.lit(0).cast("bigint").alias("ingestion_timestamp"),
    )


def few_users(df):
    """Users folded onto five, so that one window holds several persons and many auctions."""
    return df.withColumn("user_id", F.col("user_id") % 5)


@pytest.mark.parametrize("salts", [1, 8])
def test_new_users_of_closed_windows(landing, slices, events, tmp_path, salts):
    landing.add(*slices)
    stream = new_users_with_auctions(
        people(few_users(landing.stream("ts"))), sales(few_users(landing.stream("ts"))), "1 day",
        salts=salts,
    )
    got = run_available_now(stream, str(tmp_path / "out"), config(tmp_path))
    batch = new_users_with_auctions(people(few_users(events)), sales(few_users(events)), "1 day")
    ends = events.where("event_type IN ('signup', 'purchase')").groupBy("event_type")
    closed = min(r[0] for r in ends.agg(F.max(F.unix_millis("ts"))).select("max(unix_millis(ts))").collect())
    want = batch.where(F.col("window_evicting") <= closed)
    assert rows(got) == rows(want)
    assert got.count() > 20


def test_new_user_pairs_as_they_come(landing, slices, events, tmp_path):
    landing.add(*slices)
    stream = new_user_auction_pairs(
        people(landing.stream("ts")), sales(landing.stream("ts")), "1 day"
    )
    got = run_available_now(stream, str(tmp_path / "out"), config(tmp_path))
    assert rows(got) == rows(new_user_auction_pairs(people(events), sales(events), "1 day"))


def numbers(df):
    shard = F.pmod(F.col("event_id"), F.lit(4)).cast("string")
    return df.select(F.col("event_id").alias("value"), shard.alias("shard"))


@pytest.mark.parametrize("rows_per_bucket", [1, 1_000_000])
def test_count_stream_goes_on_after_a_restart(landing, slices, events, spark, tmp_path, rows_per_bucket):
    """Also with another number of shuffle partitions after the restart."""
    path, partitions = str(tmp_path / "out"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for part, width in ((slices[:2], 4), (slices[2:], 7)):
            spark.conf.set("spark.sql.shuffle.partitions", str(width))
            landing.add(*part)
            query = count_stream(
                numbers(landing.stream()), "shard", "value", path, config(tmp_path),
                rows_per_bucket=rows_per_bucket,
            )
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    want = running_count(numbers(events), "shard", "value")
    assert rows(read_counted(spark, path, want.schema)) == rows(want)


def test_a_replayed_micro_batch_counts_once(landing, slices, events, spark, tmp_path):
    """Running the last micro-batch again, as after a crash before its commit."""
    path = str(tmp_path / "out")
    landing.add(*slices)
    for attempt in range(2):
        query = count_stream(numbers(landing.stream()), "shard", "value", path, config(tmp_path))
        query.awaitTermination()
        if attempt == 0:
            forget_last_commit(tmp_path / "checkpoint" / "commits")
    want = running_count(numbers(events), "shard", "value")
    assert rows(read_counted(spark, path, want.schema)) == rows(want)


def forget_last_commit(commits):
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (commits / f".{last.name}.crc").unlink(missing_ok=True)


def test_runs_over_a_stream(landing, slices, events, spark, tmp_path):
    path = str(tmp_path / "out")
    landing.add(*slices)
    name = run_id(F.col("shard"), F.col("seq")).alias("run")
    query = count_stream(
        numbers(landing.stream()), "shard", "value", path, config(tmp_path),
        then=lambda df: df.select("value", name),
    )
    query.awaitTermination()
    want = running_count(numbers(events), "shard", "value").select("value", name)
    assert rows(read_counted(spark, path, want.schema)) == rows(want)


def test_stateful_count_to_csv_with_a_restart(landing, slices, events, spark, tmp_path):
    out = str(tmp_path / "csv")
    for part in (slices[:2], slices[2:]):
        landing.add(*part)
        counted = stateful_count(numbers(landing.stream()), "shard")
        write_csv(counted, out, config(tmp_path)).awaitTermination()
    got = spark.read.schema(counted.schema).csv(out)
    per_shard = got.groupBy("shard").agg(
        F.count("*"), F.min("seq"), F.max("seq"), F.count_distinct("seq")
    )
    n = events.count() // 4
    assert rows(per_shard) == [(str(s), n, 1, n, n) for s in range(4)]
    assert rows(got.select("value", "shard")) == rows(numbers(events))


def test_text_sink_batch_and_stream(landing, slices, events, spark, tmp_path):
    landing.add(*slices)
    write_text(events, str(tmp_path / "batch"), column="event_type")
    write_text(
        landing.stream(), str(tmp_path / "stream"), config(tmp_path), column="event_type"
    ).awaitTermination()
    want = rows(events.select("event_type"))
    assert rows(spark.read.text(str(tmp_path / "batch"))) == want
    assert rows(spark.read.text(str(tmp_path / "stream"))) == want


def test_csv_sink_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "n bigint, t string")
    write_csv(df, str(tmp_path / "out"))
    lines = rows(spark.read.text(str(tmp_path / "out")))
    assert lines == [("1,é",), ("2,",)]
    with pytest.raises(Exception, match="already exists"):
        write_csv(df, str(tmp_path / "out"))


def test_a_stream_needs_a_checkpoint(landing, slices, tmp_path):
    landing.add(slices[0])
    with pytest.raises(ValueError):
        write_csv(landing.stream(), str(tmp_path / "out"))


def interval_query(spark, tmp_path, **how):
    stream = interval_sequence_stream(spark, 5, 254, shards=3, rows_per_batch=how.pop("rows_per_batch", 100), partitions=2)
    settings = StreamConfig(str(tmp_path / "c"), **how)
    return lambda: settings.writer(stream).format("parquet").option("path", str(tmp_path / "out")).start()


def interval_rows(spark, tmp_path):
    return rows(spark.read.schema("value bigint, shard string").parquet(str(tmp_path / "out")))


@pytest.mark.parametrize("how", [{"trigger_interval_ms": 0}, {"available_now": True}])
def test_interval_stream_is_the_interval(spark, tmp_path, how):
    start = interval_query(spark, tmp_path, **how)
    for _ in range(2):  # the second time nothing is left
        run_to_end(start, 254)
    want = interval_sequence(spark, 5, 254, shards=3)
    assert interval_rows(spark, tmp_path) == rows(want)
    assert want.count() == 250


def test_interval_stream_goes_on_after_a_restart(spark, tmp_path):
    interval_query(spark, tmp_path, available_now=True)().awaitTermination()  # one micro-batch
    assert sorted(v for v, _ in interval_rows(spark, tmp_path)) == list(range(5, 105))
    run_to_end(interval_query(spark, tmp_path, trigger_interval_ms=0), 254)
    assert interval_rows(spark, tmp_path) == rows(interval_sequence(spark, 5, 254, shards=3))


def test_one_run_over_what_is_available_gives_the_whole_interval(spark, tmp_path):
    interval_query(spark, tmp_path, available_now=True, rows_per_batch=None)().awaitTermination()
    assert interval_rows(spark, tmp_path) == rows(interval_sequence(spark, 5, 254, shards=3))


def test_a_failing_interval_query_raises(spark, tmp_path):
    stream = interval_sequence_stream(spark, 0, 99, shards=2, rows_per_batch=40)
    broken = stream.select(F.when(F.col("value") == 50, F.raise_error(F.lit("no fifty"))).alias("x"), "value")
    settings = StreamConfig(str(tmp_path / "c"), 0)
    with pytest.raises(Exception, match="no fifty"):
        run_to_end(lambda: settings.writer(broken).format("parquet").option("path", str(tmp_path / "out")).start(), 99)


def test_interval_bounds(spark):
    for start, end, shards in ((5, 5, 1), (5, 4, 1), (0, 5, 0)):
        with pytest.raises(ValueError):
            interval_sequence(spark, start, end, shards)
    with pytest.raises(ValueError):
        interval_sequence_stream(spark, 0, 5, 1, rows_per_batch=0)


def test_stream_settings():
    conf = StreamConfig("c").state_conf()
    assert conf["spark.sql.streaming.stateStore.providerClass"].endswith("RocksDBStateStoreProvider")
    assert set(conf.values()) >= {"true"}
    memory = StreamConfig("c", state_backend="memory").state_conf()
    assert memory["spark.sql.streaming.stateStore.providerClass"].endswith("HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError):
        StreamConfig("c", state_backend="disk")
    with pytest.raises(ValueError):
        StreamConfig("c", -1)


def test_a_used_store_refuses_a_new_checkpoint(spark, tmp_path):
    from tidemark.sinks import upsert_latest

    source = tmp_path / "in"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "shard string, value long").coalesce(1).write.parquet(str(source))
    stream = lambda: spark.readStream.schema("shard string, value long").parquet(str(source))
    config = lambda name: StreamConfig(str(tmp_path / name), available_now=True)
    counted = str(tmp_path / "counted")
    for _ in range(2):  # started again on its own checkpoint it just goes on
        count_stream(stream(), "shard", "value", counted, config("one")).awaitTermination()
    assert spark.read.parquet(f"{counted}/rows").count() == 3
    with pytest.raises(ValueError, match="belongs to the checkpoint"):
        count_stream(stream(), "shard", "value", counted, config("two"))
    latest, totals = str(tmp_path / "latest"), lambda: stream().groupBy("shard").count()
    upsert_latest(totals(), latest, config("three")).awaitTermination()
    with pytest.raises(ValueError, match="belongs to the checkpoint"):
        upsert_latest(totals(), latest, config("four"))


def test_one_shard_with_most_rows_over_several_batches(spark, tmp_path):
    source = tmp_path / "in"
    for part in range(3):
        rows = [("hot" if i % 10 else f"s{i % 7}", part * 1000 + i) for i in range(1000)]
        spark.createDataFrame(rows, "shard string, value long").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("shard string, value long").option("maxFilesPerTrigger", 1).parquet(str(source))
    path = str(tmp_path / "counted")
    config = StreamConfig(str(tmp_path / "c"), available_now=True)
    count_stream(stream, "shard", "value", path, config, rows_per_bucket=50).awaitTermination()
    got = spark.read.parquet(f"{path}/rows").select("shard", "seq").collect()
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["seq"])
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in shards.values()) and len(shards["hot"]) == 2700


def test_snapshots_keep_the_store_small(spark, tmp_path):
    source = tmp_path / "in"
    for part in range(9):
        spark.createDataFrame([("a", part), (f"k{part % 3}", part)], "key string, value long").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("key string, value long").option("maxFilesPerTrigger", 1).parquet(str(source))
    totals = stream.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    path = str(tmp_path / "latest")
    upsert_latest(totals, path, StreamConfig(str(tmp_path / "c"), available_now=True), ["key"], snapshot_every=2).awaitTermination()
    want = spark.read.parquet(str(source)).groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    got = read_latest(spark, path, ["key"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kept = [p.name for p in (tmp_path / "latest").iterdir() if p.name.startswith("batch_id=")]
    assert len(kept) <= 4


def test_results_have_the_stated_schemas(spark):
    from tidemark import schemas
    from tidemark.operators.campaigns import campaign_counts

    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    views = spark.createDataFrame([("x", at)], "ad_id string, event_time timestamp")
    dim = spark.createDataFrame([("x", "c", 1)], "ad_id string, campaign_id string, event_time int")
    counted = running_count(spark.createDataFrame([(at, 1, "s")], "event_time timestamp, value long, shard string"), "shard", "value")
    regions = sliding_count(spark.createDataFrame([(1, at)], "region int, at timestamp"), "region", "at", 60, 30)
    people = spark.createDataFrame([(1, 7, "Ann", at, 2)], "timestamp long, person_id long, name string, event_time timestamp, ingestion_timestamp long")
    sales = spark.createDataFrame([(1, 5, 7, at, 2)], "timestamp long, auction_id long, person_id long, event_time timestamp, ingestion_timestamp long")
    for frame, schema in (
        (campaign_counts(views, dim), schemas.WINDOWED_COUNT),
        (counted, schemas.COUNTED_NUMBER),
        (regions, schemas.REGION_WINDOW),
        (new_users_with_auctions(people, sales), schemas.NEW_USER_AUCTION),
    ):
        assert {f.name: f.dataType for f in frame.schema} == {f.name: f.dataType for f in schema}


@pytest.mark.parametrize(("before", "after"), [(12, 4), (4, 12), (6, 4)])
def test_another_number_of_shards_after_a_restart(landing, slices, events, spark, tmp_path, before, after):
    """Counts are summed by remainder: no number of a shard comes twice, and all rows are counted."""
    path = str(tmp_path / "out")
    schema = "value long, shard string, seq long"

    def dealt(df, shards):
        return df.select(F.col("event_id").alias("value"), F.pmod("event_id", F.lit(shards)).cast("string").alias("shard"))

    for part, shards in ((slices[:2], before), (slices[2:], after)):
        landing.add(*part)
        count_stream(dealt(landing.stream(), shards), "shard", "value", path, config(tmp_path), shards=shards).awaitTermination()
    got = read_counted(spark, path, spark.createDataFrame([], schema).schema)
    assert got.count() == events.count() == got.select("shard", "seq").distinct().count()
    counts = spark.read.parquet(f"{path}/counts/batch_id=3")
    assert counts.agg(F.sum("seq")).first()[0] == events.count()
    assert {int(r["shard"]) for r in counts.collect()} <= set(range(max(after, 4)))
    if before % after == 0:  # then a shard's count is that of its rows
        late = got.where(F.col("shard").cast("int") < after).groupBy("shard").agg(F.max("seq").alias("n"))
        want = dealt(events, after).groupBy("shard").count()
        assert rows(late) == rows(want)


def run_lines(numbers):
    """Numbered ad views, two a second."""
    return [f"{i},u1,p1,ad1,banner,view,{1704067200000 + 500 * i},255.255.255.255" for i in numbers]


def test_campaign_runs_as_a_lasting_stream(spark, tmp_path):
    """Equal to the batch on closed windows, over a restart and rows that come too late."""
    from tidemark.plans import jobs
    from tidemark.streaming.closing import read_closed

    as_of, schema = datetime(2024, 6, 1, tzinfo=timezone.utc), "campaign_id string, count bigint, latency_ms bigint, window_ms bigint"
    folder, path = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def add(name, lines):
        (folder / name).write_text("".join(f"{line}\n" for line in lines))

    def run():
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder))
        query = jobs.campaign_run_stream(stream, path, StreamConfig(str(tmp_path / "c"), 0), "10 seconds", shards=2, as_of=as_of)
        query.processAllAvailable()
        query.stop()

    batch = lambda df: jobs.campaign_latencies(df, None, "10 seconds", as_of=as_of, shards=2)
    as_lines = lambda lines: spark.createDataFrame([(x,) for x in lines], "value string")
    add("0.txt", run_lines(range(37)))
    run()
    closed = read_closed(spark, path, schema)
    first = rows(closed)
    assert first == rows(batch(as_lines(run_lines(range(37)))).where("window_ms < 1704067210000"))
    add("1.txt", run_lines(range(37, 90)))
    run()
    want = batch(as_lines(run_lines(range(90)))).where("window_ms < 1704067240000")
    assert rows(read_closed(spark, path, schema)) == rows(want) and len(first) < want.count()
    late = [line.replace(str(1704067200000 + 500 * i), "1704067201000") for i, line in zip(range(90, 95), run_lines(range(90, 95)), strict=True)]
    add("2.txt", late)
    run()
    assert rows(read_closed(spark, path, schema)) == rows(want)
    assert len(list((tmp_path / "out" / "open").glob("batch_id=*"))) <= 2


def test_windows_close_once_and_a_replay_writes_over(spark, tmp_path):
    from tidemark.streaming.closing import close_windows, read_closed

    path, schema = str(tmp_path / "w"), "window_start timestamp, k string, count bigint, last_update timestamp"
    at = lambda s: START + timedelta(seconds=s)
    frame = lambda *r: spark.createDataFrame(list(r), "k string, t timestamp")
    close = lambda n, *r, delay="0 seconds": close_windows(frame(*r), n, path, "k", "t", "10 seconds", delay)
    counts = lambda: sorted(((r["window_start"].second, r["k"], r["count"]) for r in read_closed(spark, path, schema).collect()), key=repr)
    close(0)
    assert counts() == []
    close(1, ("a", at(1)), (None, at(2)), (None, at(3)), ("a", None))
    assert counts() == []
    close(2, ("a", at(4)), ("b", at(12)), delay="3 seconds")  # the watermark is at 9
    assert counts() == []
    for _ in range(2):  # a replay
        close(3, ("a", at(5)), ("b", at(13)), delay="3 seconds")  # at 10: reached
        assert counts() == sorted([(0, "a", 3), (0, None, 2)], key=repr)
    close(4, ("a", at(6)), ("c", at(30)))
    assert counts() == sorted([(0, "a", 3), (0, None, 2), (10, "b", 2)], key=repr)
