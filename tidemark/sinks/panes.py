"""A store of panes, by window: early rows while a window is open, and its final rows, which stay as they are.

Every micro-batch writes its own rows and nothing else, so what it writes does
not grow with the time the stream has run. Early rows lie in
``open/<window>/<batch>``, final ones in ``final/<batch>``; a replayed batch
writes over its own. Windows whose final rows came ``grace`` micro-batches ago
are noted as closed: from then on readers leave their early rows unread. These
are removed another ``grace`` micro-batches and ``grace_s`` seconds later, so
a reader that began before has that long to end.
"""

from __future__ import annotations

import posixpath
import time
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.sinks.latest import BATCH, drop_folders
from tidemark.streaming.config import StreamConfig
from tidemark.streaming.owner import claim

WINDOW = "window_us"
GRACE, GRACE_S = 20, 600.0


def store_panes(df: DataFrame, path: str, config: StreamConfig, grace: int = GRACE, grace_s: float = GRACE_S) -> StreamingQuery:
    """Start a query whose rows (with ``window_start`` and ``final``) go to the store at ``path``.

    The store belongs to the checkpoint it was first used with; another one is refused.
    """
    claim(df.sparkSession, path, config.checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            early = rows.where("not final").drop("final").withColumns({WINDOW: F.unix_micros("window_start"), BATCH: F.lit(batch_id).cast("long")})
            writer = early.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(WINDOW, BATCH)
            writer.parquet(posixpath.join(path, "open"))
            final = rows.where("final").drop("final")
            if final.head(1):
                final.write.mode("overwrite").parquet(posixpath.join(path, "final", f"{BATCH}={batch_id}"))
        finally:
            rows.unpersist()
        if batch_id and batch_id % grace == 0:
            _close(spark, path, batch_id, grace, grace_s)

    return config.writer(df).foreachBatch(store).start()


_MARK = "batch_id bigint, at double, window_us bigint"


def _marks(spark: SparkSession, path: str) -> list[tuple[int, float, int]]:
    """Notes of closed windows: micro-batch, time, and the last window that was closed then."""
    try:
        rows = spark.read.schema(_MARK).option("recursiveFileLookup", "true").json(posixpath.join(path, "_closed"))
        return sorted((r["batch_id"], r["at"], r["window_us"]) for r in rows.orderBy(F.desc("batch_id")).limit(100).collect())
    except AnalysisException:
        return []


def _close(spark: SparkSession, path: str, batch_id: int, grace: int, grace_s: float) -> None:
    """Note which windows are closed by now, and remove the early rows of those that were noted long enough ago."""
    marks, final = _marks(spark, path), _final(spark, path, None)
    before = max((b for b, _, _ in marks if b < batch_id), default=0)
    if final is not None:
        since = final.where((F.col(BATCH) > before - grace) & (F.col(BATCH) <= batch_id - grace))
        last = since.agg(F.max(F.unix_micros("window_start"))).first()[0]
        if last is not None:
            mark = spark.createDataFrame([(batch_id, time.time(), last)], _MARK).coalesce(1)
            mark.write.mode("overwrite").json(posixpath.join(path, "_closed", f"{BATCH}={batch_id}"))
    old = [w for b, at, w in marks if b <= batch_id - grace and at <= time.time() - grace_s]
    if old:
        gone = lambda name: name.startswith(f"{WINDOW}=") and int(name.removeprefix(f"{WINDOW}=")) <= max(old)
        drop_folders(spark, posixpath.join(path, "open"), gone)


def _final(spark: SparkSession, path: str, schema: StructType | None) -> DataFrame | None:
    return _stored(spark, posixpath.join(path, "final"), schema, [BATCH])


def _stored(spark: SparkSession, path: str, schema: StructType | None, parts: Sequence[str]) -> DataFrame | None:
    """The rows below ``path``, with the names of their folders as columns; None if there are none."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(StructType([*schema.fields, *[StructField(p, LongType()) for p in parts]]))
    try:
        return reader.parquet(path)
    except AnalysisException:
        return None


def read_panes(spark: SparkSession, path: str, keys: Sequence[str], schema: StructType) -> DataFrame:
    """The rows of the store: final ones, and of each other window and key the newest early one; with ``final``.

    ``schema`` is that of the stored stream. Closed windows are left out by their folders, unread.
    """
    closed_to = max((w for _, _, w in _marks(spark, path)), default=None)
    plain = StructType([f for f in schema.fields if f.name != "final"])
    final, early = _final(spark, path, plain), _stored(spark, posixpath.join(path, "open"), plain, [WINDOW, BATCH])
    empty = spark.createDataFrame([], plain)
    done = (final.select(*plain.names) if final is not None else empty).withColumn("final", F.lit(True))
    if early is None:
        return done.select(*schema.names)
    if closed_to is not None:
        early = early.where(F.col(WINDOW) > closed_to)
    closed = done.select("window_start", *[k for k in keys if k != "window_start"]).distinct()
    values = [c for c in plain.names if c not in keys]
    newest = early.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(BATCH)).alias("_row")).select(*keys, "_row.*")
    on = [newest[k].eqNullSafe(closed[k]) for k in closed.columns]
    still = newest.join(closed, on, "left_anti").withColumn("final", F.lit(False))
    return done.select(*schema.names).unionByName(still.select(*schema.names))
