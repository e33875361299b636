"""A store of the latest row per key, fed by results that are revised.

Each micro-batch lands in a folder of its own, named by its number and written
over when the batch is replayed, so a failed and repeated batch counts once.
Readers pick the newest row per key. Now and then a batch's folder gets the
newest row of every key instead of the changed ones: a snapshot, noted once it
is complete. Readers start at the last one, and what is older than the one
before it is removed, so the store grows with its keys and not with time.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.streaming.config import StreamConfig
from tidemark.streaming.owner import claim

BATCH = "batch_id"
COMPACTED = -1
SNAPSHOT_EVERY = 50


def upsert_latest(
    df: DataFrame,
    path: str,
    config: StreamConfig,
    keys: Sequence[str] | None = None,
    snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Start an update-mode query whose changed rows go to the store at ``path``.

    With ``keys`` every ``snapshot_every``-th micro-batch leaves a snapshot. The
    store belongs to the checkpoint it was first used with; another one is
    refused.
    """
    claim(df.sparkSession, path, config.checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = posixpath.join(path, f"{BATCH}={batch_id}")
        if not keys or batch_id == 0 or batch_id % snapshot_every:
            batch.write.mode("overwrite").parquet(folder)
            return
        before = _last_snapshot(spark, path)
        older = _since(spark, path, before, batch.schema).where(F.col(BATCH) < batch_id)
        new = batch.withColumn(BATCH, F.lit(batch_id).cast("long"))
        _newest(older.unionByName(new), keys).select(*batch.columns).write.mode("overwrite").parquet(folder)
        mark = spark.createDataFrame([(str(batch_id),)], "value string").coalesce(1)
        mark.write.mode("overwrite").text(posixpath.join(path, "_snapshots", str(batch_id)))
        if before is not None:
            drop_batches(spark, path, before)

    return config.writer(df).outputMode("update").foreachBatch(store).start()


def _last_snapshot(spark: SparkSession, path: str) -> int | None:
    try:
        marks = spark.read.option("recursiveFileLookup", "true").text(posixpath.join(path, "_snapshots"))
        return marks.agg(F.max(F.col("value").cast("long"))).first()[0]
    except AnalysisException:
        return None


def _since(spark: SparkSession, path: str, snapshot: int | None, schema: StructType | None) -> DataFrame:
    """Rows of the store from a snapshot on, with their batch."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(StructType([*schema.fields, StructField(BATCH, LongType())]))
    rows = reader.parquet(path)
    return rows if snapshot is None else rows.where(F.col(BATCH) >= snapshot)


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in {*keys, BATCH}]
    newest = F.max_by(F.struct(*values), F.col(BATCH)).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def drop_batches(spark: SparkSession, path: str, before: int) -> None:
    """Remove the folders of micro-batches with smaller numbers."""
    drop_folders(spark, path, lambda name: name.startswith(f"{BATCH}=") and int(name.removeprefix(f"{BATCH}=")) < before)


def drop_folders(spark: SparkSession, path: str, which: Callable[[str], bool]) -> None:
    """Remove the folders directly below ``path`` whose name is wanted gone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf)
    if files.exists(root):
        for status in files.listStatus(root):
            if which(status.getPath().getName()):
                files.delete(status.getPath(), True)


def read_latest(
    spark: SparkSession, path: str, keys: Sequence[str], schema: StructType | None = None
) -> DataFrame:
    """The newest row of each key in the store; combines before its one shuffle."""
    return _newest(_since(spark, path, _last_snapshot(spark, path), schema), keys)


def compact_latest(spark: SparkSession, path: str, into: str, keys: Sequence[str]) -> None:
    """Write the newest row of each key in the store at ``path`` to a new store at ``into``.

    Done while the feeding query is stopped; started again on its checkpoint, it
    can go on with ``into``. The rows get a number before all micro-batches, so
    one that is replayed still replaces them.
    """
    read_latest(spark, path, keys).write.parquet(posixpath.join(into, f"{BATCH}={COMPACTED}"))
