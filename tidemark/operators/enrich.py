"""Enrichment of a fact table or stream with a keyed dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import join_unique

MISSING = ("error", "drop", "keep")

# A dimension up to this size is sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024

# Slices a stream meets a larger one in.
STREAM_SALTS = 8


@dataclass(frozen=True)
class DimensionSize:
    rows: int
    text_bytes: int

    @property
    def bytes(self) -> int:
        """Rough size of the dimension as a hash table."""
        return self.text_bytes + 64 * self.rows


def check_dimension(dim: DataFrame, on: str) -> DimensionSize:
    """Measure ``dim``; two rows with one key, or a row without key, are an error."""
    text = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in dim.columns]
    per_key = dim.groupBy(on).agg(
        F.count("*").alias("rows"), F.sum(sum(text[1:], text[0])).alias("bytes")
    )
    row = per_key.agg(
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"),
        F.max("rows").alias("most"),
        F.count_if(F.col(on).isNull()).alias("nameless"),
    ).first()
    if row["nameless"]:
        raise ValueError(f"dimension has rows without {on}")
    if (row["most"] or 0) > 1:
        raise ValueError(f"dimension has more than one row for some {on}")
    return DimensionSize(row["rows"] or 0, row["bytes"] or 0)


def enrich(
    df: DataFrame,
    dim: DataFrame,
    on: str = "ad_id",
    missing: str = "error",
    broadcast_bytes: int = BROADCAST_BYTES,
    size: DimensionSize | None = None,
    split_hot: bool = True,
    stream_salts: int = STREAM_SALTS,
) -> DataFrame:
    """Add the columns of ``dim`` to each row of ``df``; works on streams too.

    ``dim`` must hold each key once, which is checked, as is its size: only a
    small one is broadcast. ``missing`` says what becomes of a row whose key
    ``dim`` lacks: the job fails, the row is dropped, or it is kept with nulls.
    ``size`` is the result of an earlier check, which then is not made again.
    Without ``split_hot`` no hot keys are looked for, which takes two passes
    over the keys of ``df``: right where ``df`` holds few rows per key anyway.
    A stream meets a large ``dim`` in ``stream_salts`` slices, so that the rows
    of a hot key are spread over so many tasks. The slices are merged, as Spark
    would go by the size of the files and broadcast all copies of the rows.
    """
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}, not {missing!r}")
    size = size or check_dimension(dim, on)
    how = "inner" if missing == "drop" else "left"
    # A mark tells a missing key from a key whose columns are null.
    marked = dim.withColumn("_found", F.lit(True))
    if size.bytes <= broadcast_bytes:
        joined = df.join(F.broadcast(marked), on, how)
    elif df.isStreaming and stream_salts > 1:
        slices = F.explode(F.sequence(F.lit(0), F.lit(stream_salts - 1))).alias("_salt")
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(stream_salts)).cast("int")
        joined = df.withColumn("_salt", salt).join(marked.select("*", slices).hint("merge"), [on, "_salt"], how).drop("_salt")
    elif df.isStreaming:
        joined = df.join(marked.hint("merge"), on, how)
    elif not split_hot:
        joined = df.join(marked, on, how)
    else:
        joined = join_unique(df, marked, [on], how)
    if missing == "error":
        complaint = F.concat(
            F.lit(f"no row in the dimension for {on} = "),
            F.coalesce(F.col(on).cast("string"), F.lit("null")),
        )
        joined = joined.where(
            F.when(F.col("_found").isNotNull(), F.lit(True)).otherwise(
                F.raise_error(complaint).cast("boolean")
            )
        )
    return joined.drop("_found")
