"""Joins and groups in which one key may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, DataType, StructType

from tidemark.session import parallelism

# No more keys than this are looked for, however wide the session.
MAX_HOT_KEYS = 1000

# Keys the sketch of frequent ones tracks, for each key wanted.
TRACKED_PER_KEY = 20


def _common_types(a: DataFrame, b: DataFrame, on: Sequence[str]) -> list[DataType]:
    """For each key the type that values of both sides are compared in."""
    return [f.dataType for f in a.select(*on).limit(0).union(b.select(*on).limit(0)).schema]


def _hash(on: Sequence[str], types: Sequence[DataType]) -> Column:
    return F.xxhash64(*[F.col(k).cast(t) for k, t in zip(on, types, strict=True)])


def hot_key_hashes(
    facts: DataFrame, on: Sequence[str], max_keys: int | None = None, types: Sequence[DataType] | None = None
) -> list[int]:
    """Hashes of the keys that hold more than one ``max_keys``-th of the rows.

    One pass over the key columns, in which a sketch of bounded size follows
    the most frequent keys; about ``max_keys`` numbers at most reach the driver.
    """
    limit = max_keys or max(2, min(parallelism(facts.sparkSession), MAX_HOT_KEYS))
    kinds = types or [facts.schema[k].dataType for k in on]
    sketch = F.expr(f"approx_top_k(_key, {limit}, {TRACKED_PER_KEY * limit})").alias("top")
    row = facts.select(_hash(on, kinds).alias("_key")).agg(F.count("*").alias("rows"), sketch).first()
    return [t["item"] for t in row["top"] or [] if t["count"] * limit > row["rows"]]


def join_unique(
    facts: DataFrame,
    unique: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_hot_keys: int | None = None,
) -> DataFrame:
    """Join ``facts`` to a side with at most one row per key, whatever the key skew.

    Rows of hot keys are dealt to as many slices as the session is wide, and
    their partner rows are copied to each slice: ``max_hot_keys`` keys at most,
    so the copies are few. Both sides are read once for it, after one pass over
    the keys of ``facts``. The sketch decides how a row travels, never whether
    it is kept.
    """
    on, types = list(on), _common_types(facts, unique, on)
    hot = hot_key_hashes(facts, on, max_hot_keys, types)
    if not hot:
        return facts.join(unique, on, how)
    slices = parallelism(facts.sparkSession)
    is_hot = _hash(on, types).isin(hot)
    plain = [f.name for f in facts.schema.fields if isinstance(f.dataType, (AtomicType, StructType))]
    slice_of = F.when(is_hot, F.pmod(F.xxhash64(*plain), F.lit(slices)).cast("int")).otherwise(F.lit(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.lit(0)))
    left = facts.withColumn("_slice", slice_of)
    right = unique.withColumn("_slice", F.explode(copies))
    return left.join(right, [*on, "_slice"], how).drop("_slice")
