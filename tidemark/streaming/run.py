"""Run a stream over what is there now and read its result as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.session import scratch_path
from tidemark.sinks.files import write_parquet
from tidemark.sinks.latest import read_latest, upsert_latest
from tidemark.streaming.config import StreamConfig


def run_available_now(
    df: DataFrame,
    path: str | None = None,
    config: StreamConfig | None = None,
    latest_by: list[str] | None = None,
) -> DataFrame:
    """Run ``df`` to the end of its available input; rows stay in files throughout.

    With ``latest_by`` the query runs in update mode and the newest row per
    those keys is returned, otherwise it appends. Result and checkpoint go to
    fresh folders in the cluster's shared folder unless given.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "result")
    config = config or StreamConfig(scratch_path(spark, "stream"), available_now=True)
    if latest_by:
        upsert_latest(df, path, config, latest_by).awaitTermination()
        return read_latest(spark, path, latest_by, df.schema)
    write_parquet(df, path, config).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
