"""Delimited lines to typed rows, with a verdict on every line.

All parsers take a DataFrame with a ``value`` column, batch or streaming, and
work in one of three modes:

``failfast``    typed rows; the job fails on the first bad line
``quarantine``  two DataFrames: typed rows, and ``value`` with a ``reason``
``tagged``      all lines: ``value``, typed columns (null if bad) and ``reason`` (null if
                good); one pass is enough to store both kinds
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import to_double, to_long
from tidemark.functions.time import epoch_ms, from_epoch_ms, now_or

MODES = ("failfast", "quarantine", "tagged")

# Spark times count microseconds in 64 bits, which bounds the milliseconds.
MAX_EPOCH_MS = (2**63 - 1) // 1000


@dataclass(frozen=True)
class Field:
    """A column read from position ``index``.

    ``kind`` is text, long, double, ms (a time kept as milliseconds) or time
    (the same, as a timestamp).
    """

    name: str
    index: int
    kind: str = "text"


def _typed(kind: str, raw: Column) -> Column:
    if kind in ("long", "ms", "time"):
        return to_long(raw)
    return to_double(raw) if kind == "double" else raw


def _in_range(field: Field) -> Column:
    """A time field that Spark can show as a timestamp, in the form its kind asks for."""
    ms = F.col(field.name)
    shown = from_epoch_ms(ms) if field.kind == "time" else ms
    return F.when(ms.between(-MAX_EPOCH_MS, MAX_EPOCH_MS), shown)


# What a rejected field is called.
_COMPLAINTS = {
    "long": "not a whole number",
    "double": "not a number",
    "ms": "not a time in milliseconds",
    "time": "not a time in milliseconds",
    "text": "missing",
}


def _parse(
    lines: DataFrame,
    fields: Sequence[Field],
    mode: str,
    delimiter: str = ",",
    exact_parts: int | None = None,
    derived: dict[str, Column] | None = None,
):
    """Split, convert and judge; ``derived`` adds columns computed from the typed ones.

    Empty fields at the end of a line count as missing, and fields behind the
    last one needed are ignored, unless ``exact_parts`` fixes their number.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    line = F.col("value")
    # Trimming is slow and rarely needed, so it is asked for first.
    ends_empty = F.endswith(line, F.lit(delimiter))
    full = F.when(ends_empty, F.rtrim(line, F.lit(delimiter))).otherwise(line)
    parts = F.split(full, delimiter, -1)
    typed = lines.select(line, parts.alias("_parts")).select(
        line,
        F.size("_parts").alias("_size"),
        *[_typed(f.kind, F.get("_parts", F.lit(f.index))).alias(f.name) for f in fields],
    )
    times = {f.name: _in_range(f) for f in fields if f.kind in ("ms", "time")}
    typed = typed.withColumns(times) if times else typed

    needed = max(f.index for f in fields) + 1
    reasons = [F.when(line.isNull(), F.lit("no line"))]
    if exact_parts is None:
        reasons.append(
            F.when(F.col("_size") < needed, F.lit(f"fewer than {needed} fields"))
        )
    else:
        reasons.append(F.when(~F.contains(line, F.lit(delimiter)), F.lit("no delimiter")))
        reasons.append(
            F.when(F.col("_size") != exact_parts, F.lit(f"not exactly {exact_parts} fields"))
        )
    for f in fields:
        reasons.append(F.when(F.col(f.name).isNull(), F.lit(f"{f.name}: {_COMPLAINTS[f.kind]}")))
    # A verdict tied to the running task is not deterministic to the optimizer, which
    # therefore leaves filters above it: pushed below, they would repeat all parsing.
    here = F.spark_partition_id() >= 0
    judged = typed.withColumn("reason", F.when(here, F.coalesce(*reasons))).drop("_size")

    columns = {f.name: F.col(f.name) for f in fields} | (derived or {})
    if mode == "tagged":
        is_good = F.col("reason").isNull()
        shown = [F.when(is_good, column).alias(name) for name, column in columns.items()]
        return judged.select(line, *shown, "reason")
    columns = [column.alias(name) for name, column in columns.items()]
    good = judged.where(F.col("reason").isNull()).select(*columns)
    if mode == "quarantine":
        return good, judged.where(F.col("reason").isNotNull()).select(line, "reason")
    complaint = F.concat_ws("", F.lit("malformed line ("), F.col("reason"), F.lit("): "), line)
    # A filter, as a guard in a column would vanish when the column is not read.
    checked = judged.where(
        F.when(F.col("reason").isNull(), F.lit(True)).otherwise(
            F.raise_error(complaint).cast("boolean")
        )
    )
    return checked.select(*columns)


def parse_timestamped_numbers(lines: DataFrame, mode: str = "failfast"):
    """``epochMs#number`` to (``event_time``, ``value``).

    In tagged mode ``value`` is the line, and the number is called ``number``.
    """
    fields = [Field("event_time", 0, "time"), Field("number", 1, "long")]
    parsed = _parse(lines, fields, mode, delimiter="#", exact_parts=2)
    if mode == "tagged":
        return parsed
    if mode == "quarantine":
        good, rejected = parsed
        return good.withColumnRenamed("number", "value"), rejected
    return parsed.withColumnRenamed("number", "value")


def _parse_with_event_time(lines, fields, mode, ingest_time):
    """Keeps the time both as milliseconds and as a timestamp, and stamps the ingestion."""
    derived = {
        "event_time": from_epoch_ms(F.col("timestamp")),
        "ingestion_timestamp": epoch_ms(now_or(ingest_time)),
    }
    return _parse(lines, fields, mode, derived=derived)


def parse_persons(
    lines: DataFrame, mode: str = "failfast", ingest_time: datetime | Column | None = None
):
    """Ten comma-separated fields of a new person."""
    names = ["name", "email", "city", "country", "province", "zipcode", "homepage", "creditcard"]
    fields = [Field("timestamp", 0, "ms"), Field("person_id", 1, "long")]
    fields += [Field(name, index) for index, name in enumerate(names, start=2)]
    return _parse_with_event_time(lines, fields, mode, ingest_time)


def parse_auctions(
    lines: DataFrame, mode: str = "failfast", ingest_time: datetime | Column | None = None
):
    """Eight comma-separated fields of a new auction; the item comes before the person."""
    fields = [
        Field("timestamp", 0, "ms"),
        Field("auction_id", 1, "long"),
        Field("item_id", 2, "long"),
        Field("person_id", 3, "long"),
        Field("initial_price", 4, "double"),
        Field("category_id", 5, "long"),
        Field("start", 6, "long"),
        Field("end", 7, "long"),
    ]
    return _parse_with_event_time(lines, fields, mode, ingest_time)


def parse_ad_events(lines: DataFrame, mode: str = "failfast", numbered: bool = False):
    """Seven comma-separated fields of an ad event; ``numbered`` lines start with an id."""
    names = ["user_id", "page_id", "ad_id", "ad_type", "event_type", "event_time", "ip_address"]
    shift = 1 if numbered else 0
    fields = [Field("id", 0, "long")] if numbered else []
    fields += [
        Field(name, index + shift, "time" if name == "event_time" else "text")
        for index, name in enumerate(names)
    ]
    return _parse(lines, fields, mode)


def parse_geo_events(lines: DataFrame, mode: str = "failfast"):
    """Latitude, longitude, a skipped field, and a category."""
    return _parse(
        lines, [Field("lat", 0, "long"), Field("lng", 1, "long"), Field("category", 3)], mode
    )
