"""Running counts: numbering is 1..n per shard along the order, however shards are cut."""

from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.counting import (
    _cut,
    assign_runs,
    counted_text,
    every_nth,
    running_count,
    running_count_of_equals,
)


def expected(rows, key=lambda row: row[1:]):
    """(shard, order...) rows with their number, by sorting each shard in memory."""
    shards = defaultdict(list)
    for row in rows:
        shards[row[0]].append(row)
    out = []
    for members in shards.values():
        members.sort(key=key)
        out += [(*row, i) for i, row in enumerate(members, start=1)]
    return sorted(out, key=repr)


def numbered(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows_per_bucket", [1, 1_000_000])
def test_hot_and_null_shards(spark, rows_per_bucket):
    rows = [("hot" if i % 3 else None if i % 2 else f"s{i % 7}", (i * 7919) % 4001) for i in range(4001)]
    df = spark.createDataFrame(rows, "shard string, at bigint")
    got = numbered(running_count(df, "shard", "at", rows_per_bucket=rows_per_bucket))
    assert got == expected(rows)


def test_no_task_gets_a_whole_hot_shard(spark):
    df = spark.range(40_000).withColumn("shard", F.lit("only"))
    counted = running_count(df, "shard", "id", rows_per_bucket=1)
    counts = counted.withColumn("task", F.spark_partition_id()).groupBy("task").count()
    previous = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in counts.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", previous)
    assert sum(sizes) == 40_000
    assert max(sizes) < 40_000
    assert counted.where("seq != id + 1").count() == 0


def test_one_order_value_holds_most_rows(spark):
    """A crowded first order column is cut along the next one."""
    rows = [("a", 5 if i % 4 else i, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "shard string, at bigint, id bigint")
    counted = running_count(df, "shard", ["at", "id"], rows_per_bucket=1)
    assert numbered(counted) == expected(rows)


def test_ties_in_the_only_order_column_are_cut_too(spark):
    rows = [("a", 5 if i % 4 else i, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "shard string, at bigint, id bigint")
    cut, buckets = _cut(df, ["at"], 1)
    sizes = [r["count"] for r in cut.groupBy(*buckets).count().collect()]
    assert max(sizes) < 1000
    counted = running_count(df, "shard", "at", rows_per_bucket=1)
    got = sorted((r["seq"], r["at"]) for r in counted.collect())
    assert got == list(enumerate(sorted(at for _, at, _ in rows), start=1))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "double", "decimal(20,3)", "int"])
def test_order_kinds(spark, kind):
    number = F.pmod(F.col("id") * 7919, F.lit(500))
    if kind.startswith("timestamp"):
        at = F.timestamp_millis(number).cast(kind)
    elif kind == "date":
        at = F.date_from_unix_date(number.cast("int"))
    else:
        at = number.cast(kind)
    df = spark.range(500).select(F.lit("a").alias("shard"), at.alias("at"), number.alias("n"))
    counted = running_count(df, "shard", "at", rows_per_bucket=1)
    assert counted.where("seq != n + 1").count() == 0
    assert counted.count() == 500


def test_null_order_values_come_first(spark):
    rows = [("a", None if i < 1 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "shard string, at bigint")
    counted = running_count(df, "shard", "at", rows_per_bucket=1)
    assert counted.where("at IS NULL").first()["seq"] == 1
    assert counted.where("at = 5").first()["seq"] == 6


def test_both_zeros_and_infinities_keep_their_place(spark):
    values = [float("-inf"), -3.0, -1.0, *[-0.0, 0.0] * 100, 1.0, float("inf"), float("nan")]
    df = spark.createDataFrame([("a", v, i) for i, v in enumerate(values)], "shard string, at double, id int")
    counted = running_count(df, "shard", ["at", "id"], rows_per_bucket=1)
    assert counted.where("seq != id + 1").count() == 0


def test_order_without_a_place_is_refused(spark):
    with pytest.raises(TypeError):
        running_count(spark.createDataFrame([("a", True)], "shard string, at boolean"), "shard", "at")


@pytest.mark.parametrize("rows_per_bucket", [1, 1_000_000])
def test_count_goes_on_from_a_start(spark, rows_per_bucket):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 7)], "shard string, at bigint")
    start = spark.createDataFrame([("a", 100), ("c", 5)], "shard string, seq bigint")
    counted = running_count(df, "shard", "at", start=start, rows_per_bucket=rows_per_bucket)
    got = {(r["shard"], r["at"]): r["seq"] for r in counted.collect()}
    assert len(got) == 51
    assert got[("a", 0)] == 101 and got[("a", 49)] == 150 and got[("b", 7)] == 1


def test_empty_input(spark):
    df = spark.createDataFrame([], "shard string, at bigint")
    assert running_count(df, "shard", "at", rows_per_bucket=1).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.integers(-3, 3), st.integers(-(2**62), 2**62)),
        min_size=1,
        max_size=60,
        unique=True,
    )
)
def test_any_rows_any_cut(spark, rows):
    df = spark.createDataFrame(rows, "shard string, at bigint, id bigint")
    counted = running_count(df, "shard", ["at", "id"], rows_per_bucket=1)
    assert numbered(counted) == expected(rows)


def test_counted_text(spark):
    row = spark.range(1).select(counted_text(F.lit(7), F.lit("2"), F.lit(3)).alias("t")).first()
    assert row["t"] == "7 - 2 - 3"


@pytest.mark.parametrize("rows_per_bucket", [1, 1_000_000])
def test_runs(spark, rows_per_bucket):
    df = spark.range(25).withColumn("shard", F.lit("a"))
    runs = assign_runs(df, "shard", "id", 10, rows_per_bucket=rows_per_bucket)
    sizes = {r["campaign_id"]: r["count"] for r in runs.groupBy("campaign_id").count().collect()}
    assert sizes == {"a-0": 10, "a-1": 10, "a-2": 5}


def test_every_nth(spark):
    df = spark.range(1, 8).withColumn("shard", F.lit("a"))
    assert [r["id"] for r in every_nth(df, 3, "shard", "id").collect()] == [3, 6]
    assert every_nth(df, 1, "shard", "id").count() == 7
    with pytest.raises(ValueError):
        every_nth(df, 0, "shard", "id")


def test_text_orders_are_cut_too(spark):
    rows = [("s", f"{prefix}{i:03d}") for prefix in ("", "é", "same-prefix-") for i in range(40)]
    df = spark.createDataFrame(rows, "shard string, line string")
    got = running_count(df, "shard", "line", rows_per_bucket=7).collect()
    order = sorted((line for _, line in rows), key=lambda x: x.encode())
    assert {r["line"]: r["seq"] for r in got} == {line: i + 1 for i, line in enumerate(order)}


def _numbered(rows):
    return sorted((r["shard"] or "", r["value"] or "", r["seq"]) for r in rows)


@pytest.mark.parametrize(("rows_per_bucket", "stretch"), [(1, 1), (1, 7), (1_000_000, 50), (1_000_000, 1_000_000)])
def test_equal_rows_are_numbered_as_rows_are(spark, rows_per_bucket, stretch):
    values = ["hot"] * 300 + [f"v{i % 40}" for i in range(200)] + [None] * 30 + ["", "x"]
    rows = [(v, None if i % 9 == 0 else str(i % 3)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "value string, shard string").repartition(5)
    got = running_count_of_equals(df, "shard", "value", rows_per_bucket=rows_per_bucket, stretch=stretch)
    assert got.columns == ["value", "shard", "seq"]
    assert _numbered(got.collect()) == _numbered(running_count(df, "shard", "value").collect())


def test_equal_rows_go_on_from_a_start(spark):
    start = spark.createDataFrame([("a", 10), ("b", 5)], "shard string, seq long")
    df = spark.createDataFrame([("x", "a")] * 4 + [("y", "a"), ("x", "c")], "value string, shard string")
    got = running_count_of_equals(df, "shard", "value", start=start, stretch=2).collect()
    assert _numbered(got) == [("a", "x", n) for n in (11, 12, 13, 14)] + [("a", "y", 15), ("c", "x", 1)]


def test_one_line_with_half_of_the_rows_is_numbered_by_many_tasks(spark):
    lines = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("value"))
    df = lines.withColumn("shard", F.lit("0"))
    got = running_count_of_equals(df, "shard", "value", stretch=1000)
    hot = got.where("value = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(hot) == 4 and max(r["count"] for r in hot) < 60_000
    assert got.agg(F.countDistinct("seq"), F.min("seq"), F.max("seq")).first() == (200_000, 1, 200_000)


def test_equal_rows_have_no_other_columns(spark):
    with pytest.raises(ValueError):
        running_count_of_equals(spark.createDataFrame([("x", "a", 1)], "value string, shard string, more int"), "shard", "value")
    empty = spark.createDataFrame([], "value string, shard string")
    assert running_count_of_equals(empty, "shard", "value").collect() == []
