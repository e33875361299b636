"""Windowed counts of rows that a micro-batch has to make first, such as numbered ones.

Spark's own windows follow the rows of a source. Rows that ``foreachBatch`` makes
never reach them, so here each micro-batch adds its counts to those of the windows
still open, which lie in a folder per micro-batch, as the counts of a shard do.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sinks.latest import drop_batches

MARK = "mark_us bigint"


def close_windows(
    rows: DataFrame,
    batch_id: int,
    path: str,
    key: str,
    time: str,
    width: str,
    delay: str = "0 seconds",
    then: Callable[[DataFrame], DataFrame] | None = None,
    form: str = "parquet",
) -> None:
    """Count the rows of a micro-batch per tumbling window and ``key``, and store the windows that are over.

    What an append-mode window count gives: a window is stored once, when the
    watermark (the latest time so far, less ``delay``) has reached its end, and
    rows of windows that were over before the micro-batch are dropped. Rows
    without a time belong to no window. Closed windows go through ``then`` to
    ``<path>/rows``, in a folder per micro-batch that a replay writes over.
    Open windows (``<path>/open``) and the watermark (``<path>/marks``) go on
    to the next micro-batch; older ones are removed. Counts combine before
    their one shuffle, and only open windows are written again, so a
    micro-batch costs its own rows and what is open.
    """
    spark = rows.sparkSession

    def folder(kind: str, number: int) -> str:
        return posixpath.join(path, kind, f"batch_id={number}")

    stamp = F.col(time).cast("timestamp")
    window = F.window(stamp, width)
    ones = rows.select(window.alias("_window"), F.col(key), F.lit(1).cast("long").alias("count"), stamp.alias("last_update"))
    parts = ones.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), key, "count", "last_update")
    before = _mark(spark, folder("marks", batch_id - 1)) if batch_id > 0 else None
    if before is not None:
        parts = parts.where(F.unix_micros("window_end") > F.lit(before))
    if batch_id > 0:
        parts = parts.unionByName(spark.read.schema(parts.schema).parquet(folder("open", batch_id - 1)))
    counts = parts.groupBy("window_start", "window_end", key).agg(
        F.sum("count").alias("count"), F.max("last_update").alias("last_update")
    )
    counts = counts.persist()
    try:
        latest = counts.agg(F.max(F.unix_micros(F.col("last_update") - _interval(delay)))).first()[0]
        mark = max((m for m in (before, latest) if m is not None), default=None)
        over = F.unix_micros("window_end") <= F.lit(mark) if mark is not None else F.lit(False)
        closed = counts.where(over).drop("window_end")
        closed = then(closed) if then else closed
        closed.write.mode("overwrite").format(form).save(folder("rows", batch_id))
        counts.where(~over).write.mode("overwrite").parquet(folder("open", batch_id))
        spark.createDataFrame([(mark,)], MARK).coalesce(1).write.mode("overwrite").parquet(folder("marks", batch_id))
    finally:
        counts.unpersist()
    for kind in ("open", "marks"):
        drop_batches(spark, posixpath.join(path, kind), batch_id - 1)


def _mark(spark: SparkSession, path: str) -> int | None:
    return spark.read.schema(MARK).parquet(path).first()["mark_us"]


def _interval(text: str) -> Column:
    return F.expr(f"interval '{text}'")


def read_closed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The windows that ``close_windows`` has stored at ``path``."""
    return spark.read.schema(schema).parquet(posixpath.join(path, "rows")).drop("batch_id")
