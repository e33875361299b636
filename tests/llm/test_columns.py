"""Extra columns may be called as the operators' own columns are, inside or in the result."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import edge_cases
from tidemark.llm import licenses, ngram_join, packing, piece_codec, pii, quality, secret_scan, substring
from tidemark.llm.columns import carry

PIECES = public_tokenizers.path("piece_bpe_32k.model")
INNER = [
    "text", "batch", "bucket", "bits", "n_words", "n_removed", "spans", "kept_sha256", "kept_text", "base", "added", "text_to_scan",
    "score", "text_to_score", "ids", "round_trip", "text_to_encode", "license", "dice", "line", "licenses", "n_matches", "Base", "carried_0",
    "a.b", "odd `name`",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with a column of every inner name, each with its own value."""
    plain = edge_cases.documents(spark).select("doc_id", "text")
    extra = [c for c in INNER if c not in ("text", "Base")]
    return plain.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in extra])


def check(result, names, own):
    """Each kept column is there under its outer name, with its own value."""
    rows = result.collect()
    assert rows and set(own) <= set(result.columns)
    for name in names:
        outer = f"input_{name}" if name in own else name
        at = result.columns.index(outer)
        id_at = result.columns.index("doc_id")
        assert all(r[at] == (None if r[id_at] is None else f"{name} {r[id_at]}") for r in rows), name


NAMES = [c for c in INNER if c not in ("text", "Base")]


@pytest.mark.parametrize("texts", [False, True])
def test_substring(docs, texts):
    own = ["n_words", "n_removed", "kept_sha256", "spans"] + ["kept_text"] * texts
    check(substring.dedup(docs, NAMES, texts=texts), NAMES, own)


def test_spans(docs):
    check(pii.find(docs, ["doc_id", *NAMES]), NAMES, ["base", "added"])
    check(secret_scan.find(docs, ["doc_id", *NAMES], secret_scan.fit(docs)), NAMES, ["base", "added"])


def test_quality(docs):
    model = quality.QualityModel(b"", b"", (), 0.5)
    check(quality.score(docs, model, ["doc_id", *NAMES]), NAMES, ["score"])


def test_pieces(docs):
    check(piece_codec.encode(docs, PIECES, ["doc_id", *NAMES]), NAMES, ["ids"])
    check(piece_codec.encode_and_check(docs, PIECES, ["doc_id", *NAMES]), NAMES, ["ids", "round_trip"])
    encoded = docs.drop("ids").withColumn("ids", F.array(F.lit(3)))
    names = [c for c in NAMES if c != "ids"]
    check(piece_codec.decode(encoded, PIECES, ["doc_id", *names]), names, ["text"])


def test_licenses(docs):
    check(licenses.scan(docs, ["doc_id", *NAMES]), NAMES, ["license", "dice", "line", "licenses", "n_matches"])


def test_packing(spark):
    items = spark.range(40).select(
        F.col("id").alias("sequence_id"), F.lit("o").alias("offset"), F.lit(7).alias("block_of_pieces"),
        F.lit("x").alias("carried_0"), F.lit(90).cast("long").alias("length"), F.col("id").alias("salt"),
    )
    got = packing.pack(items, 200)
    rows = got.collect()
    assert sorted(r["input_sequence_id"] for r in rows) == list(range(40)) and len({r["sequence_id"] for r in rows}) == 20
    assert all((r["input_offset"], r["block_of_pieces"], r["carried_0"]) == ("o", 7, "x") for r in rows)


def test_upper_and_lower_case_are_alike(spark):
    docs = spark.createDataFrame([(1, "a", "kept")], "doc_id long, text string, BASE string")
    assert pii.find(docs, ["doc_id", "BASE"]).columns == ["doc_id", "input_BASE", "base", "added"]
    assert carry(["x", "input_x"], ["x"])[1] == ["carried_0", "carried_1"]


def test_keep_first_without_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(4, words, "a"), (None, words + " more", "b"), (None, other, "c"), (None, other + " more", "d"), (7, "alone", "e"), (None, "", "f"), (4, words, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number string")
    kept = ngram_join.keep_first(docs, ngram_join.Likeness(shingle=5, percent=80))
    assert kept.columns == docs.columns
    got = sorted(r["number"] for r in kept.collect())
    assert got in (["a", "c", "d", "e", "f"], ["c", "d", "e", "f", "g"])
