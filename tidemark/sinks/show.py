"""Rows on the console, for a look at a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.streaming.config import StreamConfig


def print_rows(
    df: DataFrame, rows: int = 20, config: StreamConfig | None = None, output_mode: str = "append"
) -> StreamingQuery | None:
    """Print the first rows of a batch, or of each micro-batch of a stream."""
    if df.isStreaming:
        writer = (config or StreamConfig()).writer(df).outputMode(output_mode)
        return writer.format("console").option("numRows", rows).option("truncate", False).start()
    df.show(rows, truncate=False)
    return None
