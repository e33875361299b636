"""Settings of a streaming query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

# Names of the state backends, and the interval between checkpoints.
STATE_BACKENDS = ("memory", "filesystem", "rocksdb")
CHECKPOINT_INTERVAL_MS = 1000

_PROVIDERS = "org.apache.spark.sql.execution.streaming.state."


@dataclass(frozen=True)
class StreamConfig:
    """How a stream is run.

    ``checkpoint`` is a folder all executors share: it holds source positions
    and state, and a query started on it again goes on where it stopped. Spark
    checkpoints with every micro-batch, so the interval between checkpoints is
    the trigger interval. State lives in executor memory with snapshots in the
    checkpoint ("memory" and "filesystem" mean the same here), or in RocksDB on
    local disk, which holds more state than memory does; ``incremental`` then
    uploads changes instead of whole snapshots.
    """

    checkpoint: str | None = None
    trigger_interval_ms: int = CHECKPOINT_INTERVAL_MS
    available_now: bool = False
    state_backend: str = "rocksdb"
    incremental: bool = True

    def __post_init__(self) -> None:
        if self.state_backend not in STATE_BACKENDS:
            raise ValueError(
                f"state backend must be one of {STATE_BACKENDS}, not {self.state_backend!r}"
            )
        if self.trigger_interval_ms < 0:
            raise ValueError("trigger interval must not be negative")

    def state_conf(self) -> dict[str, str]:
        rocksdb = self.state_backend == "rocksdb"
        provider = "RocksDBStateStoreProvider" if rocksdb else "HDFSBackedStateStoreProvider"
        return {
            # With RocksDB the four kinds of join state share one store per partition.
            "spark.sql.streaming.join.stateFormatVersion": "3" if rocksdb else "2",
            "spark.sql.streaming.stateStore.providerClass": _PROVIDERS + provider,
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": str(
                rocksdb and self.incremental
            ).lower(),
        }

    def apply(self, spark: SparkSession) -> None:
        """Make the session use the state backend; read when a query starts."""
        for key, value in self.state_conf().items():
            spark.conf.set(key, value)

    def writer(self, df: DataFrame) -> DataStreamWriter:
        """A stream writer of ``df`` with checkpoint, trigger and state backend set."""
        self.apply(df.sparkSession)
        writer = df.writeStream
        if self.checkpoint:
            writer = writer.option("checkpointLocation", self.checkpoint)
        if self.available_now:
            return writer.trigger(availableNow=True)
        return writer.trigger(processingTime=f"{self.trigger_interval_ms} milliseconds")
