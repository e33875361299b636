"""Good and rejected lines of one read, each with its verdict, as one table that a job goes on from.

Lines are read and judged once and written to ``<path>/rejected=true`` (with
the reason) and ``<path>/rejected=false``. A stream's files are committed by
the sink's own log, which the job's stream reads: each line reaches it once,
also after restarts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.streaming.config import StreamConfig

SCHEMA = "value string, reason string, rejected boolean"
COUNTS = "verdicts"


def write_verdicts(lines: DataFrame, parse: Callable[..., DataFrame], path: str, config: StreamConfig | None = None) -> StreamingQuery | None:
    """Write every line with ``parse``'s verdict. A stream reports how many were read and rejected in its progress, as
    the observed metrics ``verdicts``."""
    judged = parse(lines, mode="tagged").select("value", "reason", F.col("reason").isNotNull().alias("rejected"))
    counted = judged.observe(COUNTS, F.count("*").alias("lines"), F.count_if("rejected").alias("rejected"))
    if lines.isStreaming:
        if config is None:
            raise ValueError("a stream needs a StreamConfig with a checkpoint folder")
        return config.writer(counted).outputMode("append").format("parquet").partitionBy("rejected").option("path", path).start()
    counted.write.mode("errorifexists").partitionBy("rejected").parquet(path)
    return None


def read_verdicts(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Lines with their verdicts."""
    reader = (spark.readStream if stream else spark.read).schema(SCHEMA)
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def good_lines(
    lines: DataFrame, parse: Callable[..., DataFrame], path: str, config: StreamConfig | None = None, max_files: int | None = None
) -> DataFrame:
    """Write the verdicts of all lines, and give the good lines to a job; only their files are read.

    A stream's verdicts are a query of their own: with ``available_now`` it has ended when the lines are given, else
    both run side by side.
    """
    query = write_verdicts(lines, parse, path, config)
    if query is not None and config.available_now:
        query.awaitTermination()
    return read_verdicts(lines.sparkSession, path, query is not None, max_files).where(~F.col("rejected")).select("value")
