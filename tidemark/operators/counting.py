"""Running counts per shard, and what is built on them: runs and every n-th row.

A shard is a logical key (a stand-in for the parallel instance a row went
through), so it may hold any share of the rows. The batch form therefore never
numbers a shard in one task: each shard is cut along its order into buckets,
every bucket is numbered on its own, and starts from the number of rows in the
buckets before it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from math import ceil, inf, isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


# Fixed value: length of the runs that share one campaign.
RUN_LENGTH = 10

# Tells apart rows the order does not.
TIE = "_tie"

# Below this many rows in all, a shard is one bucket.
ROWS_PER_BUCKET = 1_000_000

# Most cuts one column is given.
MAX_BUCKETS = 20_000

# Numbers of equal rows that are given out in one go.
STRETCH = 1_000_000


def _position(df: DataFrame, column: str) -> Column:
    """``column`` as a double that never decreases while the column rises."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double") + F.lit(0.0)  # makes -0.0 the 0.0 it equals
    if isinstance(kind, T.StringType):  # its first six bytes as a number: texts are ordered by their bytes
        head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    raise TypeError(f"order column {column} must be a number, text, date or time, not {kind}")


def _crowded(cuts: Sequence[float], kind: T.DataType) -> list[float]:
    """Cuts that several quantiles fall on: values that hold a large share of the rows.

    Only those a double shows exactly, as rows are told apart by them.
    """
    if isinstance(kind, (T.DecimalType, T.StringType)):
        return []
    return [cut for cut, times in Counter(cuts).items() if times > 1 and abs(cut) < 2**53]


def _cut(
    df: DataFrame, order: Sequence[str], rows_per_bucket: int, depth: int = 0, total: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Add bucket columns that rise with ``order``; returns their names too.

    The cuts are approximate quantiles of the first order column; they steer
    the balance only, not the result. Where one value of the column holds a
    whole quantile, its rows are cut further along the next order column, and
    after the last one by a hash of the row.
    """
    column, rest = order[0], list(order[1:])
    position, bucket, crowd = f"_pos{depth}", f"_cut{depth}", f"_crowd{depth}"
    placed = df.withColumn(position, _position(df, column))

    wanted = min(ceil((df.count() if total is None else total) / rows_per_bucket), MAX_BUCKETS)
    if wanted <= 1:
        return df, []
    shares = [i / wanted for i in range(1, wanted)]
    chosen = placed.agg(F.percentile_approx(position, shares, max(10_000, 10 * wanted))).first()[0] or []
    cuts = [cut for cut in chosen if isfinite(cut)]
    if not cuts:
        return df, []

    splits = [-inf, *sorted(set(cuts)), inf]
    placed = Bucketizer(
        splits=splits, inputCol=position, outputCol=bucket, handleInvalid="keep"
    ).transform(placed)
    # Nulls come first in the order, so they do here.
    placed = placed.withColumn(bucket, F.coalesce(F.col(bucket).cast("int"), F.lit(-1)))

    crowded = _crowded(cuts, df.schema[column].dataType)
    if crowded and not rest and column != TIE:
        plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
        placed, rest = placed.withColumn(TIE, F.xxhash64(*plain)), [TIE]
    if not crowded or not rest:
        return placed.drop(position), [bucket]
    # A crowded value opens its bucket, so its rows come before the others in it.
    in_crowd = F.coalesce(F.col(position).isin(crowded), F.lit(False))
    placed = placed.withColumn(crowd, F.when(in_crowd, 0).otherwise(1)).drop(position)
    inner, deeper = _cut(placed.where(F.col(crowd) == 0), rest, rows_per_bucket, depth + 1)
    others = placed.where(F.col(crowd) == 1)
    for name in deeper:
        others = others.withColumn(name, F.lit(0))
    both = inner.unionByName(others)
    return both.drop(TIE) if rest == [TIE] else both, [bucket, crowd, *deeper]


def running_count(
    df: DataFrame,
    shard: str,
    order: str | Sequence[str],
    name: str = "seq",
    start: DataFrame | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Number the rows of each shard 1, 2, 3 … along ``order``, as column ``name``.

    ``order`` must tell the rows of a shard apart; rows with equal values are
    numbered in any order among themselves. ``start``, if given, holds shards
    and the count (column ``name``) theirs go on from.

    Every row is shuffled once, by shard and bucket. Before that the rows are
    counted; if they are more than a bucket holds, the order is read once for
    the cuts, and shard and order once for the rows per bucket (and once more
    where single values hold whole buckets). The input must give the same rows
    each time.
    """
    return _running_sum(df, shard, order, F.lit(1).cast("bigint"), name, start, rows_per_bucket)


def running_count_of_equals(
    df: DataFrame,
    shard: str,
    order: str | Sequence[str],
    name: str = "seq",
    start: DataFrame | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    stretch: int = STRETCH,
) -> DataFrame:
    """``running_count`` of rows that are nothing but ``shard`` and ``order``, however often each of them comes.

    Rows with equal order are equal then, so they are counted before they are
    numbered: one row per shard and value meets the others, with how often it
    comes, and takes up that many numbers. These are given out in stretches,
    which are dealt over all tasks if a value has more than one. So a value
    with a third of all rows costs a row per task, and no task holds its rows.
    """
    order = [order] if isinstance(order, str) else list(order)
    if set(df.columns) != {shard, *order}:
        raise ValueError(f"rows must be {shard} and {order}, not {df.columns}")
    counted = df.groupBy(shard, *order).agg(F.count("*").alias("_times"))
    size = counted.agg(F.count("*").alias("values"), F.max("_times").alias("most")).first()
    if start is not None:
        start = start.select(shard, F.col(name).alias("_upto"))
    upto = _running_sum(counted, shard, order, F.col("_times"), "_upto", start, rows_per_bucket, size["values"])
    parts = upto.withColumn("_part", F.explode(F.expr(f"sequence(0L, (_times - 1) div {stretch})")))
    if (size["most"] or 0) > stretch:
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = parts.repartition(width, shard, *order, "_part")
    first = F.col("_upto") - F.col("_times") + 1 + F.col("_part") * stretch
    last = F.least(F.col("_upto"), first + stretch - 1)
    return parts.select(*df.columns, F.explode(F.sequence(first, last)).alias(name))


def _running_sum(
    df: DataFrame,
    shard: str,
    order: str | Sequence[str],
    step: Column,
    name: str,
    start: DataFrame | None,
    rows_per_bucket: int,
    total: int | None = None,
) -> DataFrame:
    """The sum of ``step`` over the rows of a shard up to each of them; see ``running_count``."""
    order = [order] if isinstance(order, str) else list(order)
    rows, buckets = _cut(df, order, rows_per_bucket, total=total)
    if not buckets and start is None:
        upto = Window.partitionBy(shard).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.sum(step).over(upto))

    # A shard's rows before each bucket. The bucket at -2 stands before all rows.
    sizes = rows.groupBy(shard, *buckets).agg(F.sum(step).alias("_rows"))
    if start is not None:
        before_all = [F.lit(-2).alias(b) for b in buckets]
        sizes = start.select(shard, *before_all, F.col(name).alias("_rows")).unionByName(sizes)
    if buckets:
        before = Window.partitionBy(shard).orderBy(*buckets).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carried = F.coalesce(F.sum("_rows").over(before), F.lit(0))
        carries = sizes.select(shard, *buckets, carried.alias("_step"))
    else:
        carries = start.select(shard, F.col(name).alias("_step"))

    # Each bucket gets a row in front that carries the count so far. One running
    # sum then does it all, and a null shard is a shard like any other.
    steps = rows.withColumns({"_step": step, "_carry": F.lit(False)})
    steps = steps.unionByName(
        carries.withColumn("_carry", F.lit(True)), allowMissingColumns=True
    )
    along = (
        Window.partitionBy(shard, *buckets)
        .orderBy(F.col("_carry").desc(), *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        steps.withColumn(name, F.sum("_step").over(along))
        .where(~F.col("_carry"))
        .select(*df.columns, name)
    )


def counted_text(value: Column, shard: Column, seq: Column) -> Column:
    """``value - shard - seq``."""
    return F.concat(value.cast("string"), F.lit(" - "), shard, F.lit(" - "), seq.cast("string"))


def run_id(shard: Column, seq: Column, length: int = RUN_LENGTH) -> Column:
    """Name of the run of ``length`` rows the row numbered ``seq`` belongs to."""
    run = F.floor((seq - F.lit(1)) / F.lit(length))
    return F.concat(shard, F.lit("-"), run.cast("string"))


def assign_runs(
    df: DataFrame,
    shard: str,
    order: str | Sequence[str],
    length: int = RUN_LENGTH,
    name: str = "campaign_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Give each run of ``length`` successive rows of a shard one id."""
    counted = running_count(df, shard, order, "_seq", rows_per_bucket=rows_per_bucket)
    return counted.withColumn(name, run_id(F.col(shard), F.col("_seq"), length)).drop("_seq")


def every_nth(
    df: DataFrame,
    n: int,
    shard: str,
    order: str | Sequence[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Keep rows n, 2n, 3n … of each shard."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if n == 1:
        return df
    counted = running_count(df, shard, order, "_seq", rows_per_bucket=rows_per_bucket)
    return counted.where(F.col("_seq") % F.lit(n) == 0).drop("_seq")
