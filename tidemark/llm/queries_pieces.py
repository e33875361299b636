"""op6: encode every document into pieces, and decode it again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import piece_codec
from tidemark.llm.arrow import documents


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_codec.encode_and_check(documents(spark, sf_dir), path, ["doc_id"])
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLES: dict[str, str] = {}
