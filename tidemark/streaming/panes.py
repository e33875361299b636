"""Panes of a stream: results per window and key that fire early, and once for good.

A pane is the partial result of a fold for one window and key. Rows are folded
where they are and only partial results are shuffled to the pane's state, one
row per task and pane. Panes are closed by timers of the grouped state, which
Spark looks at in every micro-batch, with input or without: by event time, when
the watermark has passed the window's end, or by the clock. Until then a pane
may fire again and again, changed or not. When it closes, its last row is
marked ``final`` and its state is gone; rows of closed windows are dropped.

Such a query never comes to rest, as its timers may always be due: run it with
a trigger interval, and stop it (``run_until``), not with ``availableNow``.
"""

from __future__ import annotations

import time as clock
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.folds import END, START, Fold, _frame, _names, _plain, _schema, partial_results

# How often a pane that does not fire early looks whether it may close.
LOOK_MS = 1000

COUNT = Fold("count bigint", (0,), lambda s, rows: (int(s[0]) + len(rows),), lambda a, b: (int(a[0]) + int(b[0]),), "count bigint", lambda s: s)


def fired_fold(
    df: DataFrame, key: str, time: str, width: str, fold: Fold, every_ms: int = 0, delay: str = "0 seconds", slide: str | None = None
) -> DataFrame:
    """Folds of event-time windows: ``window_start``, ``window_end``, ``key``, the result columns and ``final``.

    With ``every_ms`` each open pane fires that often by the clock, from its first row on. It ends with one final row,
    at the first look after the watermark (the latest time less ``delay``) has passed the window's end. ``df`` is a
    stream without a watermark of its own.
    """
    return _fired(df, key, time, width, fold, every_ms, delay, slide, by_clock=False)


def clock_fold(df: DataFrame, key: str, width: str, fold: Fold = COUNT, slide: str | None = None, every_ms: int = 0) -> DataFrame:
    """Folds of windows over the time of processing: a window closes by the clock, whether rows come or not."""
    stamped = df.withColumn("_stamp", F.current_timestamp())
    return _fired(stamped, key, "_stamp", width, fold, every_ms, "0 seconds", slide, by_clock=True)


def _fired(df, key, time, width, fold: Fold, every_ms: int, delay: str, slide: str | None, by_clock: bool) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    partials = partial_results(df, key, time, width, fold, slide).withWatermark("latest", delay)
    shown = _schema(df, f"{START} bigint, {END} bigint, `{key}` {kind}", fold.result, "final boolean")
    kept = _schema(df, fold.state, "_fires_ms bigint")
    columns = _names(df, fold.state)

    def run(at: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, end, value = int(at[0]), int(at[1]), _plain(at[2])
        now, past = state.getCurrentProcessingTimeMs(), state.getCurrentWatermarkMs()
        closed = (now if by_clock else past) * 1000 >= end
        row = lambda held, final: _frame([(start, end, value, *fold.finish(held), final)], shown)
        if state.hasTimedOut:
            *held, fires = state.get
            if closed:
                state.remove()
                yield row(tuple(held), True)
                return
            if every_ms and now >= fires:
                yield row(tuple(held), False)
                fires = now + every_ms
        else:
            if not by_clock and closed and not state.exists:
                return  # late: the window has been closed, or could have been
            *held, fires = state.get if state.exists else (*fold.start, now + every_ms)
            for chunk in chunks:
                for part in chunk[columns].astype(object).itertuples(index=False, name=None):
                    held = fold.merge(tuple(held), part)
        state.update((*held, fires))
        wait = min(fires - now, LOOK_MS) if every_ms else LOOK_MS
        if by_clock:
            wait = min(wait, end // 1000 + 1 - now) if every_ms else end // 1000 + 1 - now
        state.setTimeoutDuration(max(1, int(wait)))

    grouped = partials.groupBy(START, END, key)
    fired = grouped.applyInPandasWithState(run, shown, kept, "append", "ProcessingTimeTimeout")
    times = [F.timestamp_micros(c).alias(n) for c, n in ((START, "window_start"), (END, "window_end"))]
    return fired.select(*times, F.col(f"`{key}`"), *_names(df, fold.result), "final")


def run_until(query: StreamingQuery, done: Callable[[list[dict]], bool], timeout_s: float = 300) -> None:
    """Let a query run until ``done`` holds for what it reports of its recent micro-batches, then stop it."""
    limit = clock.monotonic() + timeout_s
    try:
        while not done([dict(p) if isinstance(p, dict) else p for p in query.recentProgress]):
            if not query.isActive:
                raise RuntimeError(f"the query has ended: {query.exception()}")
            if clock.monotonic() > limit:
                raise TimeoutError(f"not done in {timeout_s} seconds")
            clock.sleep(0.1)
    finally:
        query.stop()


def quiet(rows: int, batches: int = 3) -> Callable[[list[dict]], bool]:
    """``rows`` have been read, and ``batches`` micro-batches without input have followed."""

    def done(progress: list[dict]) -> bool:
        inputs = [p["numInputRows"] for p in progress]
        return sum(inputs) >= rows and len(inputs) > batches and not any(inputs[-batches:])

    return done


def nothing_open(rows: int) -> Callable[[list[dict]], bool]:
    """``rows`` have been read, and no pane is open any more."""

    def done(progress: list[dict]) -> bool:
        read = sum(p["numInputRows"] for p in progress)
        return read >= rows and progress[-1]["numInputRows"] == 0 and sum(op["numRowsTotal"] for op in progress[-1]["stateOperators"]) == 0

    return done
