"""op2 and op7: digests of the spans found in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pii, secret_scan
from tidemark.llm.arrow import documents


def _joined(spans):
    """``kind:start:end`` of the spans as they are ordered, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _all_in_order(kinds, *order):
    """Base and added spans together, in the order of the given fields (``rank`` is a kind's place in ``kinds``)."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    fields = lambda s: {"rank": rank[s["kind"]], "start": s["start"], "end": s["end"], "kind": s["kind"]}
    keyed = F.transform(F.concat("base", "added"), lambda s: F.struct(*[fields(s)[c].alias(c) for c in (*order, "end", "kind")]))
    return F.array_sort(keyed)


def _digest(spans: DataFrame, kinds, order, listed) -> DataFrame:
    return spans.select(
        "doc_id",
        *[_count(F.col("base"), k) for k in kinds],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(_all_in_order(listed, *order)).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.find(documents(spark, sf_dir), ["doc_id"]), pii.KINDS, ("rank", "start"), pii.KINDS)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    spans = secret_scan.find(docs, ["doc_id"], secret_scan.fit(docs))
    return _digest(spans, secret_scan.KINDS, ("start", "rank"), (*secret_scan.KINDS, secret_scan.ADDED))


QUERIES = {"op2_pii": op2_pii, "op7_secrets": op7_secrets}
ORACLES: dict[str, str] = {}
