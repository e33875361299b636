"""Folds and functions of one's own over windows.

``windowed_fold`` is for what can be merged: rows become partial results where
they are, one per task, window and key, and only these are shuffled, so a key
with a third of all rows costs a row per task. ``windowed_apply`` and
``windowed_cogroup`` hand all rows of a window and key to a function, which
therefore must fit one task; where they may not, use a fold.

Times of windows are those of ``F.window``: rows with ``start <= time < end``,
counted from the epoch; rows without a time are in no window. A null key is a
key like any other. Streams need a watermark (``event_time``); a window's
result comes once, when the watermark has passed its end, and rows that are
later still are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, TimestampType

# Windows and keys a task holds partial results of before it hands them on.
HELD = 50_000

# Rows a task gathers before it folds them, as each window and key among them costs a call.
GATHERED = 100_000

START, END = "window_start_us", "window_end_us"

# Tells apart the windows and keys whose rows a function gets at once.
GROUP = "_group"


@dataclass(frozen=True)
class Fold:
    """A fold in parts: ``start`` is the result of no rows, ``step`` adds rows to a partial result, ``merge`` joins two
    of them in any order, ``finish`` makes the result.

    Partial results are tuples of the columns ``state``, results of the columns ``result`` (schema texts). ``step`` gets
    the rows as a pandas DataFrame, so it can work on whole columns.
    """

    state: str
    start: tuple
    step: Callable[[tuple, pd.DataFrame], tuple]
    merge: Callable[[tuple, tuple], tuple]
    result: str
    finish: Callable[[tuple], tuple]


def _names(df: DataFrame, schema: str) -> list[str]:
    return _schema(df, schema).names


def _schema(df: DataFrame, *parts: str) -> StructType:
    return df.sparkSession.createDataFrame([], ", ".join(parts)).schema


def _frame(rows: list[tuple], schema: StructType) -> pd.DataFrame:
    """Rows as a frame of objects, so that nothing is rounded or given another null on the way."""
    return pd.DataFrame(rows, columns=schema.names, dtype=object)


def _plain(value):
    """A key as it is told apart: every missing value is None."""
    return None if value is None or value is pd.NaT or value != value else value


def partial_results(df: DataFrame, key: str, time: str, width: str, fold: Fold, slide: str | None = None, held: int = HELD) -> DataFrame:
    """``window_start_us``, ``window_end_us``, ``key``, the ``state`` columns, and ``latest`` (the latest time folded), per
    task; batch or stream. A task that meets more windows and keys than ``held`` hands on what it has."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    rows = df.withColumn("_window", window).withColumns(
        {START: F.unix_micros("_window.start"), END: F.unix_micros("_window.end"), "_latest": F.col(time).cast("timestamp")}
    ).drop("_window")
    kind = df.schema[key].dataType.simpleString()
    schema = _schema(df, f"{START} bigint, {END} bigint, `{key}` {kind}", fold.state, "latest timestamp")

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[tuple, tuple] = {}
        for chunk in _gathered(chunks):
            places = [chunk[c] for c in (START, END, key)]
            newest = chunk["_latest"].groupby(places, dropna=False, sort=False).max()
            parts = chunk.drop(columns=[START, END, "_latest"]).groupby(places, dropna=False, sort=False)
            for ((start, end, value), rows), newest_here in zip(parts, newest, strict=True):
                at = (int(start), int(end), _plain(value))
                state, latest = open_.get(at, (fold.start, None))
                latest = newest_here if latest is None or newest_here > latest else latest
                open_[at] = (fold.step(state, rows), latest)
            if len(open_) > held:
                yield _frame([(*at, *state, latest) for at, (state, latest) in open_.items()], schema)
                open_.clear()
        if open_:
            yield _frame([(*at, *state, latest) for at, (state, latest) in open_.items()], schema)

    return rows.mapInPandas(run, schema)


def _gathered(chunks: Iterator[pd.DataFrame], rows: int = GATHERED) -> Iterator[pd.DataFrame]:
    """Chunks of about ``rows`` rows; those whose columns have other types, as with nulls, are not joined."""
    held: list[pd.DataFrame] = []
    for chunk in chunks:
        if held and (sum(map(len, held)) >= rows or not held[0].dtypes.equals(chunk.dtypes)):
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(chunk)
    if held:
        yield pd.concat(held, ignore_index=True)


def windowed_fold(df: DataFrame, key: str, time: str, width: str, fold: Fold, slide: str | None = None) -> DataFrame:
    """``window_start``, ``key`` and the ``result`` columns of a fold per window and key, of a batch.

    (A stream's is ``streaming.panes.fired_fold``.) Partial results are sorted where they meet and merged as they
    pass, so no group of them is gathered.
    """
    partials = partial_results(df, key, time, width, fold, slide)
    kind = df.schema[key].dataType.simpleString()
    schema = _schema(df, f"{START} bigint, `{key}` {kind}", fold.result)
    states = _names(df, fold.state)
    met = partials.repartition(START, key).sortWithinPartitions(START, key)

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for chunk in chunks:
            done = []
            for start, value, *part in chunk[[START, key, *states]].astype(object).itertuples(index=False, name=None):
                here, part = (int(start), _plain(value)), tuple(part)
                if here == at:
                    state = fold.merge(state, part)
                else:
                    if at is not None:
                        done.append((*at, *fold.finish(state)))
                    at, state = here, fold.merge(fold.start, part)
            if done:
                yield _frame(done, schema)
        if at is not None:
            yield _frame([(*at, *fold.finish(state))], schema)

    merged = met.mapInPandas(run, schema)
    return merged.select(F.timestamp_micros(START).alias("window_start"), F.col(f"`{key}`"), *_names(df, fold.result))


COUNT_AND_LATEST = Fold(
    state="count bigint, last_update_us bigint",
    start=(0, None),
    step=lambda state, rows: _later(state, (len(rows), int(rows["event_us"].max()))),
    merge=lambda a, b: _later(a, b),
    result="count bigint, last_update_us bigint",
    finish=lambda state: state,
)
"""Rows and latest ``event_us`` (a column of microseconds)."""


def _later(a: tuple, b: tuple) -> tuple:
    times = [int(t) for t in (a[1], b[1]) if _plain(t) is not None]
    return int(a[0]) + int(b[0]), max(times, default=None)


# --- functions that see all rows of a window and key -----------------------------------


def windowed_apply(
    df: DataFrame, key: str, time: str, width: str, function: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str, slide: str | None = None
) -> DataFrame:
    """What ``function((window_start_us, key), rows)`` gives for each window and key; batch or stream.

    A batch groups by window and key. A stream keeps the rows as a list in the state of an aggregation, which gives
    them out once, when the window closes. The rows have the columns of ``df``.
    """
    window = F.window(time, width, slide) if slide else F.window(time, width)
    if df.isStreaming:
        listed = df.groupBy(window.alias("_window"), F.col(key)).agg(F.collect_list(F.struct(*df.columns)).alias("_rows"))
        asked = listed.select(F.unix_micros("_window.start").alias(START), F.col(key), "_rows")
        return _applied(asked, key, {"_rows": df.schema}, function, schema)
    rows = df.withColumn(START, F.unix_micros(window["start"]))
    names = df.columns
    return rows.groupBy(START, key).applyInPandas(lambda at, rows: function((int(at[0]), _plain(at[1])), rows[names]), schema)


def windowed_cogroup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    time: str,
    width: str,
    function: Callable[..., pd.DataFrame],
    schema: str,
    at_once: bool = False,
) -> DataFrame:
    """What ``function((window_start_us, key), left rows, right rows)`` gives for each window and key; batch or stream.

    Either side may be empty. ``key`` and ``time`` are columns of both. Both sides are united and grouped once, as two
    lists per window and key, so that small groups cost no call of their own into Python. A stream keeps the lists in
    one state until the watermark, which follows the slower side, closes the window.

    A call and two frames cost about a millisecond, however few rows they hold. With ``at_once`` the function is
    ``function(left rows, right rows)`` instead and gets those of many windows and keys in one call: in front of their
    own columns rows have ``_group``, a number that is the same on both sides and for all rows of a window and key, and
    ``window_start_us``. All rows of a group are in one call.
    """
    if left.isStreaming != right.isStreaming:
        raise ValueError("both sides must be streams, or neither")
    tagged = [
        d.select(F.col(time).alias("_time"), F.col(key).alias("_key"), F.struct(*d.columns).alias(side))
        for d, side in ((left, "_left"), (right, "_right"))
    ]
    union = tagged[0].unionByName(tagged[1], allowMissingColumns=True)
    lists = [F.collect_list(side).alias(side) for side in ("_left", "_right")]  # nulls, the other side's rows, are left out
    placed = union.withColumn("_window", F.window("_time", width))
    if not left.isStreaming:  # as many tasks as there are, however few bytes: what takes time is the function
        tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = placed.repartition(tasks, "_window", "_key")
    met = placed.groupBy("_window", "_key").agg(*lists)
    asked = met.select(F.unix_micros("_window.start").alias(START), F.col("_key").alias(key), "_left", "_right")
    if at_once:
        return _applied_at_once(asked, ["_left", "_right"], function, schema)
    return _applied(asked, key, {"_left": left.schema, "_right": right.schema}, function, schema)


def _applied_at_once(asked: DataFrame, sides: list[str], function, schema: str) -> DataFrame:
    zone, result = asked.sparkSession.conf.get("spark.sql.session.timeZone"), _schema(asked, schema)
    shown = to_arrow_schema(result)

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            out = function(*[_flat(chunk.column(START), chunk.column(side), zone) for side in sides])
            if len(out):
                times = [f.name for f in result.fields if isinstance(f.dataType, TimestampType)]
                out = out.assign(**{n: pd.to_datetime(out[n]).dt.tz_localize(zone) for n in times})
                yield pa.RecordBatch.from_pandas(out[result.names], shown, preserve_index=False)

    return asked.mapInArrow(run, schema)


def _flat(starts: pa.Array, lists: pa.Array, zone: str) -> pd.DataFrame:
    """The rows of all lists, each behind the number and the window of its list."""
    group, rows = pc.list_parent_indices(lists), pc.list_flatten(lists)
    columns = {GROUP: group.to_pandas(), START: starts.take(group).to_pandas()}
    for field, values in zip(rows.type, rows.flatten(), strict=True):
        column = values.to_pandas(integer_object_nulls=True)
        zoned = pa.types.is_timestamp(field.type) and field.type.tz
        columns[field.name] = column.dt.tz_convert(zone).dt.tz_localize(None) if zoned else column
    return pd.DataFrame(columns)


def _applied(asked: DataFrame, key: str, sides: dict[str, StructType], function, schema: str) -> DataFrame:
    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            given = []  # small results leave together
            for row in chunk.to_dict("records"):
                rows = [pd.DataFrame.from_records([_values(r) for r in row[s]], columns=t.names) for s, t in sides.items()]
                out = function((int(row[START]), _plain(row[key])), *rows)
                if len(out):
                    given.append(out)
                if sum(map(len, given[-1:])) > HELD or len(given) >= 1000:
                    yield pd.concat(given, ignore_index=True)
                    given = []
            if given:
                yield pd.concat(given, ignore_index=True)

    return asked.mapInPandas(run, schema)


def _values(row) -> list:
    return list(row.values()) if isinstance(row, dict) else list(row)
