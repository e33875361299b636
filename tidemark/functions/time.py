"""Time expressions; the wire form of a time is epoch milliseconds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def epoch_ms(time: Column) -> Column:
    return F.unix_millis(time)


def now_or(at: datetime | Column | None = None) -> Column:
    """``at``, or the clock: one value per batch query or micro-batch.

    A ``datetime`` should carry its zone; a naive one is taken in the
    driver's zone, as everywhere in Spark.
    """
    if at is None:
        return F.current_timestamp()
    return at if isinstance(at, Column) else F.lit(at)


def latency_ms(time: Column, as_of: datetime | Column | None = None) -> Column:
    """Milliseconds from ``time`` to ``as_of`` (default: now)."""
    return epoch_ms(now_or(as_of)) - epoch_ms(time)
