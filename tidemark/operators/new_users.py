"""New users who opened an auction in the window they joined in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import epoch_ms, now_or
from tidemark.operators.skew import join_unique
from tidemark.operators.windows import NEW_USER_WINDOW

# Slices one person's auctions are kept in while a streaming window is open.
STREAM_SALTS = 8


def _windowed(df: DataFrame, width: str) -> DataFrame:
    return df.withColumn("window", F.window("event_time", width))


def _person_columns(persons: DataFrame, width: str) -> DataFrame:
    return _windowed(persons, width).select(
        "window",
        "person_id",
        F.col("timestamp").alias("person_creation"),
        F.col("ingestion_timestamp").alias("person_ingestion"),
        F.col("name").alias("person_name"),
    )


def _auction_columns(auctions: DataFrame, width: str, *extra: Column) -> DataFrame:
    return _windowed(auctions, width).select(
        "window",
        "person_id",
        F.col("timestamp").alias("auction_creation"),
        F.col("ingestion_timestamp").alias("auction_ingestion"),
        *extra,
    )


def _first_persons(persons: DataFrame, width: str) -> DataFrame:
    """The first person of each id and window: earliest created, then ingested, then by name."""
    first = F.min(F.struct("person_creation", "person_ingestion", "person_name"))
    return (
        _person_columns(persons, width)
        .groupBy("window", "person_id")
        .agg(first.alias("person"))
        .select("window", "person_id", "person.*")
    )


def _result(joined: DataFrame, evicted_at) -> DataFrame:
    """The seven result columns; a window counts as evicted when it ends, or ``evicted_at``."""
    evicted = F.col("window.end") if evicted_at == "window end" else now_or(evicted_at)
    return joined.select(
        epoch_ms(evicted).alias("window_evicting"),
        "person_creation",
        "person_ingestion",
        "auction_creation",
        "auction_ingestion",
        "person_id",
        "person_name",
    )


def _salted_join(
    persons: DataFrame, auctions: DataFrame, width: str, salts: int
) -> DataFrame:
    """Join in slices by auction id, so that no task holds all auctions of a person."""
    salt = F.pmod(F.xxhash64("auction_id"), F.lit(salts)).cast("int").alias("salt")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    return persons.select("*", everywhere).join(
        _auction_columns(auctions, width, salt), ["person_id", "window", "salt"]
    )


def new_users_with_auctions(
    persons: DataFrame,
    auctions: DataFrame,
    width: str = NEW_USER_WINDOW,
    evicted_at="window end",
    salts: int = STREAM_SALTS,
) -> DataFrame:
    """One row per auction whose person is new in the same tumbling window.

    If an id turns up more than once in a window, its first person stands for
    it. Groups without person or without auction give nothing.

    Neither form gathers the auctions of a person. A batch reduces persons to
    one row per group before the shuffle and joins the auctions to it, those of
    hot keys in place. A stream keeps a person's auctions as single rows in the
    join state, spread over ``salts`` slices by auction id, and emits when the
    window closes. ``evicted_at`` may be a time, or None for the clock.
    """
    firsts = _first_persons(persons, width)
    if not persons.isStreaming:
        joined = join_unique(
            _auction_columns(auctions, width), firsts, ["person_id", "window"]
        )
        return _result(joined, evicted_at)

    return _result(_salted_join(firsts, auctions, width, salts), evicted_at)


def new_user_auction_pairs(
    persons: DataFrame,
    auctions: DataFrame,
    width: str = NEW_USER_WINDOW,
    evicted_at="window end",
    salts: int = STREAM_SALTS,
) -> DataFrame:
    """One row per person and auction with the same id and window; batch or stream.

    In a batch, adaptive execution splits the partitions of hot keys; the state
    of a stream is sliced as for ``new_users_with_auctions``.
    """
    if persons.isStreaming:
        joined = _salted_join(_person_columns(persons, width), auctions, width, salts)
        return _result(joined, evicted_at)
    joined = _person_columns(persons, width).join(
        _auction_columns(auctions, width), ["person_id", "window"]
    )
    return _result(joined, evicted_at)
