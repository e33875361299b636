"""Rows that queries land as a stream: slices along time, one in each micro-batch."""

import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators.folds import COUNT_AND_LATEST, Fold, partial_results
from tidemark.plans.table_queries import PANE_SLICES, ROWS_PER_FILE, _landed_in_order

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def micro_batches(stream, path):
    seen = {}

    def keep(batch, number):
        seen[number] = [(r["id"], r["us"]) for r in batch.select("id", F.unix_micros("ts").alias("us")).collect()]

    query = stream.writeStream.option("checkpointLocation", str(path)).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return [seen[n] for n in sorted(seen)]


@pytest.mark.parametrize("rows_per_file", [20, ROWS_PER_FILE])
@pytest.mark.parametrize("n, nulls", [(2000, 3), (3, 1), (0, 0)])
def test_slices_come_whole_and_in_order(spark, tmp_path, rows_per_file, n, nulls):
    rows = [(i, BEGIN + timedelta(seconds=i * 37 % 1000)) for i in range(n)] + [(-1 - i, None) for i in range(nulls)]
    df = spark.createDataFrame(rows, "id long, ts timestamp").repartition(5)
    stream = _landed_in_order(spark, df, "ts", rows_per_file=rows_per_file)
    got = micro_batches(stream, tmp_path / "ck")
    assert sorted(i for batch in got for i, _ in batch) == sorted(i for i, _ in rows)
    times = [[us for _, us in batch if us is not None] for batch in got]
    assert all(max(a) < min(b) for a, b in zip(times, times[1:]) if a and b)
    if n == 2000:
        assert len(got) == PANE_SLICES and max(map(len, times)) < n // 2


def test_a_slice_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(4000).select("id", F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))
    stream = _landed_in_order(spark, df, "ts", rows_per_file=100)
    query = stream.select(F.input_file_name().alias("f")).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    files = []
    query.foreachBatch(lambda batch, _: files.append({r["f"] for r in batch.collect()})).start().awaitTermination()
    assert [len(f) for f in files] == [4] * PANE_SLICES and len(set.union(*files)) == 4 * PANE_SLICES


def test_slices_in_other_files_than_planned_are_refused(spark):
    df = spark.range(4000).select("id", F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "50")
    try:
        with pytest.raises(RuntimeError, match="slices"):
            _landed_in_order(spark, df, "ts", rows_per_file=100)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_rows_are_gathered_before_they_are_folded(spark):
    calls = spark.sparkContext.accumulator(0)

    def step(state, rows):
        calls.add(1)
        return COUNT_AND_LATEST.step(state, rows)

    counted = Fold(COUNT_AND_LATEST.state, COUNT_AND_LATEST.start, step, COUNT_AND_LATEST.merge, COUNT_AND_LATEST.result, COUNT_AND_LATEST.finish)
    df = spark.range(0, 60_000, 1, 1).select((F.col("id") % 50).alias("k"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.col("id").alias("event_us"))
    parts = partial_results(df, "k", "ts", "10 seconds", counted).agg(F.sum("count"), F.max("last_update_us")).first()
    assert tuple(parts) == (60_000, 59_999)
    assert calls.value == 50
