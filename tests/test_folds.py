"""Folds and functions of one's own over windows."""

import sys
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators.folds import COUNT_AND_LATEST, GROUP, START, Fold, partial_results, windowed_apply, windowed_cogroup, windowed_fold

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)

SPREAD = Fold(
    state="low double, high double, n bigint",
    start=(None, None, 0),
    step=lambda s, rows: _joined(s, (rows["x"].min(), rows["x"].max(), len(rows))),
    merge=lambda a, b: _joined(a, b),
    result="spread double, n bigint",
    finish=lambda s: (s[1] - s[0], int(s[2])),
)


def _joined(a, b):
    lows, highs = ([float(v) for v in pair if v is not None] for pair in zip(a[:2], b[:2], strict=True))
    return min(lows), max(highs), int(a[2]) + int(b[2])


def table(spark, rows):
    frame = [(k, None if s is None else BEGIN + timedelta(seconds=s), float(x)) for k, s, x in rows]
    return spark.createDataFrame(frame, "k string, ts timestamp, x double")


def rows_of(n=400):
    return [(None if i % 13 == 0 else f"k{i % 5 if i % 3 else 0}", None if i % 50 == 7 else i * 7 % 95, i * 31 % 101) for i in range(n)]


def grouped(rows, width):
    out = defaultdict(list)
    for k, s, x in rows:
        if s is not None:
            out[s // width * width, k].append(x)
    return out


@pytest.mark.parametrize("held", [1, 1000])
def test_a_fold_equals_plain_groups(spark, held):
    rows = rows_of()
    df = table(spark, rows).repartition(5)
    got = windowed_fold(df, "k", "ts", "10 seconds", SPREAD).collect()
    seconds = lambda t: int((t - BEGIN.replace(tzinfo=None)).total_seconds())
    assert {(seconds(r["window_start"]), r["k"]): (r["spread"], r["n"]) for r in got} == {
        at: (max(xs) - min(xs), len(xs)) for at, xs in grouped(rows, 10).items()
    }
    assert len(got) == len(grouped(rows, 10))
    parts = partial_results(df, "k", "ts", "10 seconds", SPREAD, held=held)
    assert parts.agg(F.sum("n")).first()[0] == sum(len(xs) for xs in grouped(rows, 10).values())


def test_sliding_windows_and_empty_input(spark):
    df = table(spark, [("a", 4, 1), ("a", 9, 5)])
    got = windowed_fold(df, "k", "ts", "10 seconds", SPREAD, slide="5 seconds").collect()
    assert sorted(r["n"] for r in got) == [1, 1, 2]
    assert windowed_fold(df.limit(0), "k", "ts", "10 seconds", SPREAD).collect() == []


def test_a_hot_key_costs_a_row_per_task(spark):
    df = spark.range(100_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.col("id").alias("event_us"))
    parts = partial_results(df.repartition(6), "k", "ts", "10 seconds", COUNT_AND_LATEST)
    assert parts.count() == 6
    row = windowed_fold(df.repartition(6), "k", "ts", "10 seconds", COUNT_AND_LATEST).first()
    assert (row["count"], row["last_update_us"]) == (100_000, 99_999)


def _top(at, rows):
    best = rows.sort_values("x").iloc[-1]
    return pd.DataFrame([(at[0], at[1], best["x"], list(rows.columns) == ["k", "ts", "x"])], columns=["start", "k", "x", "plain"])


def test_a_function_sees_all_rows_of_a_window(spark):
    rows = rows_of()
    got = windowed_apply(table(spark, rows).repartition(3), "k", "ts", "10 seconds", _top, "start long, k string, x double, plain boolean").collect()
    begin = int(BEGIN.timestamp())
    assert {(r["start"] // 1_000_000 - begin, r["k"]): r["x"] for r in got} == {at: max(xs) for at, xs in grouped(rows, 10).items()}
    assert all(r["plain"] for r in got)


def _sizes(at, left, right):
    return pd.DataFrame([(at[0], at[1], len(left), len(right), list(left.columns) + list(right.columns))], columns=["start", "k", "a", "b", "names"])


def test_a_cogroup_sees_both_sides(spark):
    left, right = rows_of(200), rows_of(90)[40:]
    sides = [table(spark, r).repartition(3) for r in (left, right)]
    sides[1] = sides[1].withColumnRenamed("x", "y")
    got = windowed_cogroup(*sides, "k", "ts", "10 seconds", _sizes, "start long, k string, a long, b long, names array<string>").collect()
    want = {at: (len(grouped(left, 10)[at]), len(grouped(right, 10)[at])) for at in {*grouped(left, 10), *grouped(right, 10)}}
    begin = int(BEGIN.timestamp())
    found = {(r["start"] // 1_000_000 - begin, r["k"]): (r["a"], r["b"]) for r in got if r["start"] is not None and not pd.isna(r["start"])}
    assert found == want
    assert all(r["names"] == ["k", "ts", "x", "k", "ts", "y"] for r in got)


def test_one_side_a_stream(spark, tmp_path):
    table(spark, [("a", 1, 1)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, x double").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        windowed_cogroup(stream, table(spark, []), "k", "ts", "10 seconds", _sizes, "start long")


def _sizes_at_once(left, right):
    sizes = left.groupby(GROUP).agg(start=(START, "first"), k=("k", "first"), a=("x", "size"), last=("ts", "max"))
    sizes = sizes.join(right.groupby(GROUP).agg(start_r=(START, "first"), k_r=("k", "first"), b=("y", "size")), how="outer")
    out = pd.DataFrame({"start": sizes["start"].fillna(sizes["start_r"]), "k": sizes["k"].where(sizes["a"].notna(), sizes["k_r"])})
    return out.assign(a=sizes["a"].fillna(0), b=sizes["b"].fillna(0), last=sizes["last"]).assign(groups=len(out))


def test_a_cogroup_gets_many_groups_at_once(spark):
    left, right = rows_of(200), rows_of(90)[40:]
    sides = [table(spark, r).repartition(3) for r in (left, right)]
    sides[1] = sides[1].withColumnRenamed("x", "y")
    schema = "start long, k string, a long, b long, last timestamp, groups long"
    got = windowed_cogroup(*sides, "k", "ts", "10 seconds", _sizes_at_once, schema, at_once=True).collect()
    want = {at: (len(grouped(left, 10)[at]), len(grouped(right, 10)[at])) for at in {*grouped(left, 10), *grouped(right, 10)}}
    begin = int(BEGIN.timestamp())
    timed = [r for r in got if r["start"] is not None]
    assert {(r["start"] // 1_000_000 - begin, None if pd.isna(r["k"]) else r["k"]): (r["a"], r["b"]) for r in timed} == want
    assert max(r["groups"] for r in got) > 1
    last = sides[0].where("k = 'k1'").groupBy(F.unix_micros(F.window("ts", "10 seconds").start)).agg(F.max("ts")).collect()
    assert {(r["start"], r["last"]) for r in got if r["k"] == "k1" and r["a"] and r["start"]} == {tuple(r) for r in last if r[0] is not None}


def test_many_small_groups_take_few_calls(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(left, right):
        calls.add(1)
        return right.join(left.groupby(GROUP).size().rename("n"), GROUP, "inner")[["k", "n"]]

    rows = spark.range(20_000).select(F.col("id").alias("k"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    met = windowed_cogroup(rows, rows, "k", "ts", "10 seconds", count, "k long, n long", at_once=True)
    assert met.agg(F.sum("n"), F.count_distinct("k")).first() == (20_000, 20_000)
    assert calls.value < 100
