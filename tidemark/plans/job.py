"""A source, some transforms and a sink as one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

Source = Callable[[SparkSession], DataFrame]
Transform = Callable[[DataFrame], DataFrame]
Sink = Callable[[DataFrame], StreamingQuery | None]


@dataclass(frozen=True)
class Job:
    """``source`` makes a batch or a stream, and the rest works on either."""

    source: Source
    transforms: tuple[Transform, ...]
    sink: Sink

    def frame(self, spark: SparkSession) -> DataFrame:
        df = self.source(spark)
        for transform in self.transforms:
            df = df.transform(transform)
        return df

    def run(self, spark: SparkSession) -> StreamingQuery | None:
        """Write a batch, or start a stream and return its query."""
        return self.sink(self.frame(spark))


def job(source: Source, *transforms: Transform, sink: Sink) -> Job:
    return Job(source, transforms, sink)
