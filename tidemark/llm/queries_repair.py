"""op11: damage every conversation, and repair its structure."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import repair

EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, without end marks, repeated, or given the role user, by a hash of conversation and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    spoilt = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), spoilt.alias("text"), "kind")
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select("conv_id", "turn", "role", "text")
    )


def repair_report(rows: DataFrame, segment: int = repair.SEGMENT) -> DataFrame:
    """The report of damaged and repaired conversations, for all conversations of ``rows``."""
    turns = repair.ordered(damaged(rows))
    solved = repair.solve(turns, segment)
    out = rows.select("conv_id").distinct()
    for found in (repair.gaps(turns), repair.reports(solved), repair.digests(repair.repaired(turns, solved, segment))):
        out = repair.null_safe(out, found)
    numbers = [repair.column_or(c, 0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, repair.column_or("audit", ""), F.coalesce("sha256", F.lit(EMPTY)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES: dict[str, str] = {}
