"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts the pipelines put around a line, and the offset at
# which a filtered line carries its number.
APPENDED_TEXT = " - appended text"
RECEIVED_PREFIX = "Received: "
NUMBER_OFFSET = 10


def lowercase(text: Column) -> Column:
    return F.lower(text)


def append_text(text: Column, suffix: str = APPENDED_TEXT) -> Column:
    return F.concat(text, F.lit(suffix))


def prefix_text(text: Column, prefix: str = RECEIVED_PREFIX) -> Column:
    return F.concat(F.lit(prefix), text)


def number_after(text: Column, offset: int = NUMBER_OFFSET) -> Column:
    """The part of ``text`` after its first ``offset`` characters."""
    return F.substring(text, F.lit(offset + 1), F.length(text))


def without_cr(text: Column) -> Column:
    """Drop one trailing carriage return."""
    return F.regexp_replace(text, r"\r\z", "")
