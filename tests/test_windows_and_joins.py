"""Windows, enrichment and new users on small fixtures and against brute force."""

from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators.campaigns import ad_views, campaign_counts
from tidemark.operators.enrich import check_dimension, enrich
from tidemark.operators.new_users import new_user_auction_pairs, new_users_with_auctions
from tidemark.operators.skew import hot_key_hashes, join_unique
from tidemark.operators.windows import assign_region, event_time, sliding_count, windowed_count
from tidemark.streaming.config import StreamConfig
from tidemark.streaming.run import run_available_now

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def seconds(column):
    base = int(START.timestamp() * 1_000_000)
    return ((F.unix_micros(column) - base) / 1_000_000).alias(column)


def test_edge_of_a_tumbling_window(spark):
    df = spark.createDataFrame([("a", at(9.999)), ("a", at(10))], "k string, t timestamp")
    out = windowed_count(df, "k", "t", "10 seconds").select(
        seconds("window_start"), "k", "count", seconds("last_update")
    )
    assert sorted(tuple(r) for r in out.collect()) == [(0, "a", 1, 9.999), (10, "a", 1, 10)]


def test_tumbling_counts_add_up(spark):
    df = spark.range(1000).select(
        (F.col("id") % 7).alias("k"), F.timestamp_seconds(F.col("id") * 3).alias("t")
    )
    out = windowed_count(df, "k", "t", "10 seconds").agg(F.sum("count")).first()
    assert out[0] == 1000


def test_one_row_in_two_sliding_windows(spark):
    df = spark.createDataFrame([(3, at(45))], "region int, t timestamp")
    out = sliding_count(df, "region", "t", 60, 30).select(
        seconds("window_start"), seconds("window_end"), "region", "count"
    )
    assert sorted(tuple(r) for r in out.collect()) == [(0, 60, 3, 1), (30, 90, 3, 1)]


@pytest.mark.parametrize("size, slide", [(60, 30), (60, 60), (50, 20), (20, 50), (90, 30)])
def test_sliding_counts_match_brute_force(spark, size, slide):
    times = [(i * 37) % 1000 for i in range(400)]
    df = spark.createDataFrame([(t % 3, at(t)) for t in times], "k int, t timestamp")
    got = {
        (r["window_start"], r["k"]): r["count"]
        for r in sliding_count(df, "k", "t", size, slide)
        .select(seconds("window_start"), "k", "count")
        .collect()
    }
    want = Counter()
    offset = int(START.timestamp()) % slide
    for t in times:
        start = (t + offset) // slide * slide - offset
        while start > t - size:
            if start <= t:
                want[(start, t % 3)] += 1
            start -= slide
    assert got == dict(want)


def test_region_is_stable_and_in_range(spark):
    big = 2**62
    df = spark.createDataFrame([(52, 13), (-1, -1), (big, big), (-big, 5)], "lat bigint, lng bigint")
    got = [r[0] for r in df.select(assign_region(F.col("lat"), F.col("lng"))).collect()]
    assert got == [(31 * lat + lng) % 16 for lat, lng in [(52, 13), (-1, -1), (big, big), (-big, 5)]]


DIM = [("x", "c1"), ("y", "c2"), ("z", None)]


@pytest.fixture()
def dim(spark):
    return spark.createDataFrame(DIM, "ad_id string, campaign_id string")


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_missing_key_modes(spark, dim, broadcast_bytes):
    df = spark.createDataFrame([("x", 1), ("z", 2), ("q", 3), (None, 4)], "ad_id string, n int")

    def rows(missing):
        out = enrich(df, dim, missing=missing, broadcast_bytes=broadcast_bytes)
        return sorted((tuple(r) for r in out.select("ad_id", "n", "campaign_id").collect()), key=repr)

    assert rows("drop") == [("x", 1, "c1"), ("z", 2, None)]
    assert rows("keep") == [("q", 3, None), ("x", 1, "c1"), ("z", 2, None), (None, 4, None)]
    with pytest.raises(PySparkException, match="no row in the dimension"):
        rows("error")
    with pytest.raises(PySparkException, match="no row in the dimension"):
        enrich(df, dim, broadcast_bytes=broadcast_bytes).count()
    with pytest.raises(ValueError):
        rows("ignore")


@pytest.mark.parametrize("salts", [1, 8])
def test_a_stream_never_broadcasts_what_is_too_large(spark, dim, tmp_path, capsys, salts):
    facts, rows = str(tmp_path / "facts"), [("x", 1), ("z", 2), ("x", 3)]
    spark.createDataFrame(rows, "ad_id string, n int").write.parquet(facts)
    dim.write.parquet(str(tmp_path / "dim"))  # files tell Spark their size, which is small
    dim = spark.read.parquet(str(tmp_path / "dim"))
    out = enrich(spark.readStream.schema("ad_id string, n int").parquet(facts), dim, broadcast_bytes=0, stream_salts=salts)
    out.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    got = run_available_now(out, str(tmp_path / "out"), StreamConfig(str(tmp_path / "ck"), available_now=True)).collect()
    assert sorted((r["ad_id"], r["n"], r["campaign_id"]) for r in got) == [("x", 1, "c1"), ("x", 3, "c1"), ("z", 2, None)]


def test_a_key_with_null_columns_is_not_missing(spark, dim):
    df = spark.createDataFrame([("z", 2)], "ad_id string, n int")
    assert enrich(df, dim).first()["campaign_id"] is None


def test_dimension_is_checked(spark, dim):
    assert check_dimension(dim, "ad_id").rows == 3
    twice = dim.union(dim.limit(1))
    with pytest.raises(ValueError, match="more than one row"):
        check_dimension(twice, "ad_id")
    nameless = spark.createDataFrame([(None, "c")], "ad_id string, campaign_id string")
    with pytest.raises(ValueError, match="without"):
        check_dimension(nameless, "ad_id")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_joined_in_slices(spark, how):
    """One key with a third of the rows, a null key with a sixth, some keys unmatched."""
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0)
        .when(F.col("id") % 6 != 1, F.col("id"))
        .alias("k"),
        "id",
    )
    unique = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert len(hot_key_hashes(facts, ["k"], 10)) == 2
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_unique(facts, unique, ["k"], how, 10)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        got = sorted((tuple(r) for r in joined.select("k", "id", "v").collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    assert "_slice" in plan and "Union" not in plan
    plain = facts.join(unique, ["k"], how).select("k", "id", "v")
    assert got == sorted((tuple(r) for r in plain.collect()), key=repr)


def test_hot_keys_of_another_type_still_match(spark):
    facts = spark.createDataFrame([(1,)] * 50 + [(2,)], "k int")
    unique = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    joined = join_unique(facts, unique, ["k"], "left", 2)
    assert joined.where("v IS NULL").count() == 0


def test_no_hot_keys_in_even_data(spark):
    assert hot_key_hashes(spark.range(1000), ["id"], 10) == []


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_campaign_counts_either_way(spark, dim, broadcast_bytes):
    events = spark.createDataFrame(
        [("x", "view", at(1)), ("x", "view", at(3)), ("y", "view", at(2)), ("x", "click", at(4)),
         ("x", "view", at(12))],
        "ad_id string, event_type string, event_time timestamp",
    )
    out = campaign_counts(ad_views(events), dim, broadcast_bytes=broadcast_bytes).select(
        seconds("window_start"), "campaign_id", "count", seconds("last_update")
    )
    assert sorted(tuple(r) for r in out.collect()) == [
        (0, "c1", 2, 3), (0, "c2", 1, 2), (10, "c1", 1, 12),
    ]
    lost = events.unionByName(events.limit(1).withColumn("ad_id", F.lit("q")))
    with pytest.raises(PySparkException, match="no row in the dimension"):
        campaign_counts(ad_views(lost), dim, broadcast_bytes=broadcast_bytes).collect()


PERSON = "timestamp bigint, person_id bigint, name string, ingestion_timestamp bigint"
AUCTION = "timestamp bigint, auction_id bigint, person_id bigint, ingestion_timestamp bigint"


def timed(df):
    return df.withColumn("event_time", F.timestamp_millis("timestamp"))


def persons_of(spark, *rows):
    return timed(spark.createDataFrame(list(rows), PERSON))


def auctions_of(spark, *rows):
    return timed(spark.createDataFrame(list(rows), AUCTION))


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_persons_and_two_auctions(spark):
    persons = persons_of(spark, (2000, 7, "Bo", 9), (1000, 7, "Ann", 8))
    auctions = auctions_of(spark, (3000, 1, 7, 5), (4000, 2, 7, 6))
    assert tuples(new_users_with_auctions(persons, auctions, "10 seconds")) == [
        (10000, 1000, 8, 3000, 5, 7, "Ann"), (10000, 1000, 8, 4000, 6, 7, "Ann"),
    ]
    pairs = tuples(new_user_auction_pairs(persons, auctions, "10 seconds"))
    assert len(pairs) == 4
    assert (10000, 2000, 9, 4000, 6, 7, "Bo") in pairs


def test_one_side_only_or_other_window(spark):
    auctions = auctions_of(spark, (11000, 1, 7, 5), (3000, 2, 8, 5))
    persons = persons_of(spark, (9000, 7, "Ann", 8), (1000, 9, "Cy", 8))
    assert tuples(new_users_with_auctions(persons, auctions, "10 seconds")) == []
    assert tuples(new_user_auction_pairs(persons, auctions, "10 seconds")) == []


def test_eviction_time_may_be_given(spark):
    persons, auctions = persons_of(spark, (1000, 7, "Ann", 8)), auctions_of(spark, (3000, 1, 7, 5))
    out = new_users_with_auctions(persons, auctions, "10 seconds", evicted_at=at(0))
    assert out.first()["window_evicting"] == int(START.timestamp() * 1000)
    clock = new_users_with_auctions(persons, auctions, "10 seconds", evicted_at=None)
    assert clock.first()["window_evicting"] > int(START.timestamp() * 1000)


@pytest.mark.parametrize("width", [10, 1000])
def test_one_person_with_most_auctions(spark, width):
    """Brute force over a skewed fixture; in the wide window the hot person is joined in place."""
    ms_wide = width * 1000
    people = [(i * 500, i % 50, f"p{i}", 0) for i in range(200)]
    sales = [(i * 33, i, 3 if i % 2 else i % 50, 0) for i in range(3000)]
    groups = defaultdict(list)
    for ms, pid, name, _ in people:
        groups[(pid, ms // ms_wide)].append((ms, name))
    want = sorted(
        ((ms // ms_wide + 1) * ms_wide, *first[:1], 0, ms, 0, pid, first[1])
        for ms, _, pid, _ in sales
        if (pid, ms // ms_wide) in groups
        for first in [min(groups[(pid, ms // ms_wide)])]
    )
    out = new_users_with_auctions(
        persons_of(spark, *people), auctions_of(spark, *sales), f"{width} seconds"
    )
    assert tuples(out) == want


def test_zoneless_times_are_utc_in_any_session_zone(spark):
    times = ["2024-03-10 02:30:00", "2024-03-10 07:30:00", "2024-11-03 05:30:00", "2024-11-03 06:30:00", "1969-12-31 23:59:59"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("at"))
    want = [r[0] for r in df.select(F.unix_micros(F.col("at").cast("timestamp"))).collect()]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r[0] for r in event_time(df, "at").select(F.unix_micros("at")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want
