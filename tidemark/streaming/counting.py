"""Running counts over streams, kept across restarts."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.counting import ROWS_PER_BUCKET, running_count, running_count_of_equals
from tidemark.sinks.latest import drop_batches
from tidemark.streaming.config import StreamConfig
from tidemark.streaming.owner import claim


def stateful_count(df: DataFrame, shard: str, name: str = "seq") -> DataFrame:
    """Number the rows of each shard as they reach its task, over all micro-batches.

    State is one number per shard, and rows pass through in chunks, so nothing
    is gathered. The shuffle before may change the order of rows within a
    micro-batch, and a shard is counted by one task at a time: where shards are
    few or lopsided, or order matters, use ``count_stream``.
    """

    def count(key, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for chunk in chunks:
            yield chunk.assign(**{name: np.arange(seen + 1, seen + 1 + len(chunk))})
            seen += len(chunk)
        state.update((seen,))

    schema = StructType([*df.schema.fields, StructField(name, LongType())])
    return df.groupBy(shard).applyInPandasWithState(
        count, schema, "seen bigint", "append", "NoTimeout"
    )


def count_stream(
    df: DataFrame,
    shard: str,
    order: str | Sequence[str],
    path: str,
    config: StreamConfig,
    name: str = "seq",
    then: Callable[[DataFrame], DataFrame] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    form: str = "parquet",
    equal: bool = False,
    shards: int | None = None,
    land: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Number the rows of each shard along ``order`` within a micro-batch, on from the last.

    Each micro-batch is numbered as a batch is, so no shard has to fit one
    task; it is read from its source once and kept, with spill to disk, until
    it is stored. Rows that may be ``equal`` in all columns are counted first
    (``running_count_of_equals``). ``then`` is applied to the numbered rows before they are
    stored as files of ``form``. Rows land in ``<path>/rows`` and the counts so
    far in ``<path>/counts``, in a folder per micro-batch that a replay writes
    over (counts older than the last two are removed): a row is stored once, and the number of shuffle partitions may change
    between restarts. A path belongs to the checkpoint it was first used with;
    another one is refused.

    With ``shards``, shards are the numbers below it, as text, and it may
    change between restarts too: a shard goes on from the sum of the counts of
    all stored shards that have its remainder. That is at least its own count,
    so no number of a shard is given twice, and the counts add up to all rows.

    ``land`` gets the rows and the number of a micro-batch in place of the
    files in ``<path>/rows``; it has to bear being called again on a replay.
    """
    claim(df.sparkSession, path, config.checkpoint)

    def folder(kind: str, batch_id: int) -> str:
        return posixpath.join(path, kind, f"batch_id={batch_id}")

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = StructType([batch.schema[shard], StructField(name, LongType())])
        if batch_id > 0:
            start = spark.read.schema(kept).parquet(folder("counts", batch_id - 1))
            start = redealt(start, shard, name, shards) if shards else start
        else:
            start = spark.createDataFrame([], kept)
        batch = batch.persist()
        try:
            number = running_count_of_equals if equal else running_count
            rows = number(batch, shard, order, name, start, rows_per_bucket)
            rows = then(rows) if then else rows
            if land:
                land(rows, batch_id)
            else:
                rows.write.mode("overwrite").format(form).save(folder("rows", batch_id))
            added = batch.groupBy(shard).agg(F.count("*").alias(name))
            totals = start.unionByName(added).groupBy(shard).agg(F.sum(name).alias(name))
            totals.write.mode("overwrite").parquet(folder("counts", batch_id))
            drop_batches(spark, posixpath.join(path, "counts"), batch_id - 1)
        finally:
            batch.unpersist()

    return config.writer(df).foreachBatch(store).start()


def redealt(counts: DataFrame, shard: str, name: str, shards: int) -> DataFrame:
    """Counts per shard, summed to the shards below ``shards`` that have their remainders; counts as they are if there
    are no others."""
    number = F.pmod(F.col(shard).cast("long"), F.lit(shards)).cast(counts.schema[shard].dataType).alias(shard)
    return counts.groupBy(number).agg(F.sum(name).alias(name))


def read_counted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows a ``count_stream`` has stored at ``path``."""
    rows = spark.read.schema(schema).parquet(posixpath.join(path, "rows"))
    return rows.select(*schema.names)
