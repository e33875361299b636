import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm import edge_cases
from tidemark.llm import byte_bpe, queries_byte_bpe
from tidemark.llm.byte_bpe import Vocabulary

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENGLISH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "hello world, it's a test don't  stop\n\n  x", "", " ", "  ", "Étion dans, çouelle 12345 ügl ééé", "aaaaaaaaaaaaaaaaaaaa" * 20,
    "abababab" * 30, "x" + " " * 1000 + "y", "中文字符测试" * 30, "🙂🙃" * 20, "  　  a b \u0085", "ette" * 50, "'s'll'RE 's",
    "a\x00b\x1f", "ААА огого " * 20, "elineelineette" * 20, "\r\n\t\x0b\x0c end ", "0" * 200, "=" * 130, None,
]


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


@pytest.mark.parametrize("path", [MULTI, ENGLISH])
def test_ids_equal_the_librarys(spark, path):
    rng = random.Random(3)
    pieces = [*"aeiontsrhl  \n\t.,!1234é中🙂\x00()'", "'s", "  ", "the ", "ing", "über", "tion", "abab", "ette", " " * 70, "xyz" * 30]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    vocabulary, own = Vocabulary(path, public_tokenizers.PATTERN), library(path)
    table = byte_bpe.frequent_words(docs, vocabulary, rows=50, words=40)
    encoded = byte_bpe.encode(docs, vocabulary, ["doc_id"], table)
    got = byte_bpe.decode(encoded, vocabulary, ["doc_id", "ids"]).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == own.encode_ordinary(text), repr(text)
        assert bytes(r["data"]) == text.encode()


def test_merges_that_make_lower_ranks(spark, tmp_path):
    """Vocabularies in which joining lowers a rank, as no training gives them: words of one merge and of many."""
    rng = random.Random(9)
    for case in range(4):
        pieces = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 6))).encode() for _ in range(25)}
        order = sorted(pieces)
        rng.shuffle(order)
        ranks = {bytes([i]): i for i in range(256)} | {p: 256 + i for i, p in enumerate(order)}
        path = tmp_path / f"{case}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % r for p, r in ranks.items()))
        texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (1, 2, 5, 9, 30, 64, 65, 90, 150) for _ in range(4)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        vocabulary, own = Vocabulary(str(path), public_tokenizers.PATTERN), library(str(path))
        table = byte_bpe.frequent_words(docs, vocabulary, words=2)
        for r in byte_bpe.encode(docs, vocabulary, ["doc_id"], table).collect():
            assert r["ids"] == own.encode_ordinary(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_long_run(spark):
    vocabulary, own = Vocabulary(MULTI, public_tokenizers.PATTERN), library(MULTI)
    text = "a " + "b" * 20_000 + " " * 20_000
    docs = spark.createDataFrame([(text,)], "text string")
    ids = byte_bpe.encode(docs, vocabulary, [], byte_bpe.frequent_words(docs, vocabulary, words=1)).first()["ids"]
    assert ids == own.encode_ordinary(text)


def test_places():
    rng = random.Random(1)
    numbers = rng.sample(range(10**9), 5000)
    arrays, sizes = byte_bpe.place_entries([(n, -n) for n in numbers])
    assert all(-n in (arrays[0][n % sizes[0]], arrays[1][n % sizes[1]]) for n in numbers)
    assert byte_bpe.place_entries([])[0][0]


def test_query_and_empty_table(spark, sf_dir, tmp_path):
    own = library(MULTI)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries_byte_bpe.op12_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    edge_cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries_byte_bpe.op12_byte_bpe(spark, str(tmp_path)).collect() == []


def test_extra_columns_and_odd_ids(spark):
    vocabulary = Vocabulary(MULTI, public_tokenizers.PATTERN)
    docs = spark.createDataFrame([("x", "kept", 5)], "text string, ids string, text_to_encode int")
    table = byte_bpe.frequent_words(docs, vocabulary, words=1)
    got = byte_bpe.encode(docs, vocabulary, ["ids", "text_to_encode", "text"], table).first().asDict()
    assert got == {"input_ids": "kept", "text_to_encode": 5, "text": "x", "ids": [byte_bpe.read_ranks(MULTI)[b"x"]]}
    odd = spark.createDataFrame([(1, [64, None, -1, 10**6, 64], "d"), (2, None, "d")], "doc_id int, ids array<int>, data string")
    rows = {r["doc_id"]: r for r in byte_bpe.decode(odd, vocabulary, ["doc_id", "data"]).collect()}
    piece = vocabulary.pieces()[64].encode("latin-1")
    assert bytes(rows[1]["data"]) == piece * 2 and rows[2]["data"] is None and rows[1]["input_data"] == "d"


def test_ids_as_characters(spark):
    """Ids held as text come back, in order, on both sides of the surrogates; words fold alike up to the longest short one."""
    ids = [0, 1, 254, 0xD7FE, 0xD7FF, 0xD800, 0xDFFF, 0xFFFF, 200_000]
    text = "".join(map(byte_bpe.character, ids))
    assert sorted(text) == list(text) and text[-1] < byte_bpe.NONE
    rows = spark.createDataFrame([(text,), ("",)], "t string")
    assert [r["n"] for r in rows.select(byte_bpe.numbers(rows["t"]).alias("n")).collect()] == [ids, []]
    vocabulary, own = Vocabulary(MULTI, public_tokenizers.PATTERN), library(MULTI)
    texts = ["x", "é", "\x00", "zx" * 32, "ü" * 32, "toreesorti", "zx" * 33]
    words = spark.createDataFrame([(t,) for t in texts], "w string").coalesce(1)
    folded = vocabulary.merges().named(lambda merges: byte_bpe.fold(words["w"], merges, vocabulary.ranks()))
    got = words.select("w", byte_bpe.numbers(folded).alias("ids")).collect()
    assert [r["ids"] for r in got] == [own._core_bpe.encode_single_piece(r["w"].encode()) for r in got]
