"""op12: encode every document into byte-level pieces, and decode it again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe
from tidemark.llm.arrow import documents


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = byte_bpe.encode(documents(spark, sf_dir), vocabulary, ["doc_id"])
    decoded = byte_bpe.decode(encoded, vocabulary, ["doc_id", "ids"])
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(byte_bpe.little_endian(F.col("ids"), len(vocabulary.pieces())), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


QUERIES = {"op12_byte_bpe": op12_byte_bpe}
ORACLES: dict[str, str] = {}
