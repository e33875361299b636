"""Parquet tables of a folder, as a batch or as a stream."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import use_utc


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``: one file, or a folder of part files."""
    return use_utc(spark).read.parquet(posixpath.join(folder, f"{name}.parquet"))


def stream_table(
    spark: SparkSession,
    folder: str,
    name: str,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: str | None = None,
) -> DataFrame:
    """The same table as a stream, with the stored schema.

    A glob is used since a file stream takes no single file as its path; it
    matches a file and a folder of part files alike.
    """
    reader = spark.readStream.schema(read_table(spark, folder, name).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return reader.parquet(posixpath.join(folder, f"{name}.parquet*"))
