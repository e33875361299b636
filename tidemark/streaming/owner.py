"""Which checkpoint a result folder belongs to.

Results are stored in folders numbered by micro-batch. A new checkpoint counts
from zero again, so over a used folder its batches would mix with older ones.
"""

from __future__ import annotations

import posixpath

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def _first_line(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.text(path).first()
    except AnalysisException:
        return None
    return row["value"] if row else None


def _has_files(spark: SparkSession, path: str) -> bool:
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return bool(files.select("path").head(1))
    except AnalysisException:
        return False


def claim(spark: SparkSession, path: str, checkpoint: str | None) -> None:
    """Note that ``path`` belongs to ``checkpoint``; ValueError if it holds the results of another one, or of one that is gone."""
    if not checkpoint:
        if _has_files(spark, path):
            raise ValueError(f"{path} is not empty: a query without a lasting checkpoint needs a new folder")
        return
    mark = posixpath.join(path, "_owner")
    owner = _first_line(spark, mark)
    started = _first_line(spark, posixpath.join(checkpoint, "metadata")) is not None
    if owner is None:
        if not started and _has_files(spark, path):
            raise ValueError(f"{path} holds results already, and {checkpoint} is a new checkpoint")
        spark.createDataFrame([(checkpoint,)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    elif owner != checkpoint or not started and _has_files(spark, path):
        raise ValueError(f"{path} belongs to the checkpoint {owner}, not to a new one at {checkpoint}")
