"""Every whole number of a closed interval, exactly once, dealt out to shards."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

ROWS_PER_BATCH = 1_000_000

# Numbers that a row of the source stands for; Spark unfolds them.
STRETCH = 8192
PARTITIONS = 8


def _check(start: int, end: int, shards: int) -> None:
    if end <= start:
        raise ValueError("end must be larger than start")
    if shards < 1:
        raise ValueError("at least one shard is needed")


def interval_sequence(spark: SparkSession, start: int, end: int, shards: int = 4) -> DataFrame:
    """Numbers ``start..end``, both included, as ``value`` with their ``shard``.

    Shard *i* holds ``start + i``, ``start + i + shards`` and so on. Shards are
    a logical key: the number of Spark partitions is chosen by Spark.
    """
    _check(start, end, shards)
    offset = F.col("id") - F.lit(start)
    return spark.range(start, end + 1).select(
        F.col("id").alias("value"),
        F.pmod(offset, F.lit(shards)).cast("string").alias("shard"),
    )


class Slice(InputPartition):
    """The numbers ``first..last`` of a micro-batch."""

    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class IntervalReader(DataSourceStreamReader):
    """Moves through an interval by at most ``rows`` numbers per micro-batch, and stops at its end.

    An offset is the next number. A query that is started again tells its last
    one by asking for the partitions of what follows it, so the reader needs no
    position of its own.
    """

    def __init__(self, start: int, end: int, rows: int, partitions: int) -> None:
        self.start, self.end, self.rows, self.slices = start, end, rows, partitions
        self.at = start

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        return {"next": min(self.at + self.rows, self.end + 1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, after = start["next"], end["next"]
        self.at = max(self.at, after)
        step = max(-(-(after - first) // self.slices), 1)
        return [Slice(i, min(i + step, after) - 1) for i in range(first, after, step)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for first in range(partition.first, partition.last + 1, STRETCH):
            yield first, min(first + STRETCH - 1, partition.last)


class IntervalSource(DataSource):
    """Stretches ``(first, last)`` of the numbers ``start..end``, as a stream that has an end."""

    @classmethod
    def name(cls) -> str:
        return "number-interval"

    def schema(self) -> str:
        return "first bigint, last bigint"

    def streamReader(self, schema) -> IntervalReader:
        start, end, rows, partitions = (int(self.options[k]) for k in ("start", "end", "rows", "partitions"))
        return IntervalReader(start, end, rows, partitions)


def interval_sequence_stream(
    spark: SparkSession,
    start: int,
    end: int,
    shards: int = 4,
    rows_per_batch: int | None = ROWS_PER_BATCH,
    partitions: int | None = None,
) -> DataFrame:
    """The same numbers as a replayable stream that ends, ``rows_per_batch`` at a time, or all at once with None.

    A query over what is available now runs one micro-batch: with None that is
    the whole interval. ``run_to_end`` goes on until all numbers are through.
    """
    _check(start, end, shards)
    if rows_per_batch is not None and rows_per_batch < 1:
        raise ValueError("rows_per_batch must be at least 1")
    spark.dataSource.register(IntervalSource)
    rows = rows_per_batch or end - start + 1
    settings = {"start": start, "end": end, "rows": rows, "partitions": partitions or max(PARTITIONS, -(-rows // ROWS_PER_BATCH))}
    stretches = spark.readStream.format(IntervalSource.name()).options(**settings).load()
    return stretches.select(F.explode(F.sequence("first", "last")).alias("value")).select(
        "value", F.pmod(F.col("value") - F.lit(start), F.lit(shards)).cast("string").alias("shard")
    )


def _is_through(query: StreamingQuery, end: int) -> bool:
    """Whether a query that has ended has had the last number, by the offset it came to."""
    progress = query.lastProgress
    if not progress:
        return True  # nothing was left to do
    return json.loads(progress.json)["sources"][0]["endOffset"]["next"] > end


def run_to_end(start_query: Callable[[], StreamingQuery], end: int) -> None:
    """Run a query over ``interval_sequence_stream(start, end)`` until every number has been through it.

    A query over what is available now ends after a micro-batch and is started again on its checkpoint; one with another
    trigger is stopped once nothing is left. A query that fails raises, and can be run to its end again.
    """
    while True:
        query = start_query()
        query.processAllAvailable()  # raises if it fails
        if query.isActive:
            query.stop()
        query.awaitTermination()
        if _is_through(query, end):
            return
