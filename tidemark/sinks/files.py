"""File sinks, the same call for a batch and for a stream.

Batches are committed as a whole; streams keep a log next to the files, so
after a restart every row is there once. A stream returns its query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.streaming.config import StreamConfig


def _write(
    df: DataFrame, kind: str, path: str, config: StreamConfig | None, mode: str, **options
) -> StreamingQuery | None:
    if df.isStreaming:
        if config is None:
            raise ValueError("a stream needs a StreamConfig with a checkpoint folder")
        writer = config.writer(df).outputMode("append").format(kind).options(**options)
        return writer.option("path", path).start()
    df.write.mode(mode).format(kind).options(**options).save(path)
    return None


def write_text(
    df: DataFrame,
    path: str,
    config: StreamConfig | None = None,
    column: str = "value",
    mode: str = "errorifexists",
) -> StreamingQuery | None:
    """One line of text per row, from ``column``."""
    text = df.select(F.col(column).cast("string").alias("value"))
    return _write(text, "text", path, config, mode)


def write_csv(
    df: DataFrame,
    path: str,
    config: StreamConfig | None = None,
    delimiter: str = ",",
    mode: str = "errorifexists",
) -> StreamingQuery | None:
    """UTF-8 fields with ``delimiter`` between them, one record per line, no header."""
    return _write(df, "csv", path, config, mode, sep=delimiter, header="false", encoding="UTF-8")


def write_parquet(
    df: DataFrame, path: str, config: StreamConfig | None = None, mode: str = "errorifexists"
) -> StreamingQuery | None:
    return _write(df, "parquet", path, config, mode)
