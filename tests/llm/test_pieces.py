import itertools
import random
import time

import public_tokenizers
import pytest
import sentencepiece

from tests.llm import edge_cases
from tidemark.llm import piece_codec
from tidemark.llm.piece_codec import BPE, BYTE, NORMAL, UNIGRAM, Codec

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_models_merges(model):
    rng = random.Random(4)
    pieces = [*"aeiontsrhl  \n\t.,!1234é中🙂\x00()[]{}<>/=", "  ", "   ", "the ", "ing", "<s>", " def", "    ", "▁", "über", "tion"]
    own = piece_codec.codec(PATH)
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        ids = own.encode(text).tolist()
        assert ids == model.encode(text), repr(text)
        assert own.decode(ids) == model.decode(ids) == text.replace("▁", " ")


def test_unigram_pass_is_the_best_of_all_segmentations():
    rng = random.Random(5)
    for _ in range(60):
        pieces = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(9)} | {"▁", "▁a"}
        scored = [("<unk>", 0.0, 2)] + [(p, -rng.uniform(1, 9), NORMAL) for p in sorted(pieces)] + [(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256)]
        codec = Codec(scored, UNIGRAM)
        value = {p: s for p, s, t in scored if t == NORMAL}
        lowest = min(s for _, s, _ in scored) - 10
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        marked = "▁" + text
        best = -1e9
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(marked)]
            parts = [marked[a:b] for a, b in itertools.pairwise(at)]
            if all(p in value or len(p) == 1 for p in parts):
                best = max(best, sum(value.get(p, lowest) for p in parts))
        ids = codec.encode(text).tolist()
        got = sum(scored[i][1] if scored[i][2] == NORMAL else lowest for i in ids)
        assert abs(got - best) < 1e-9 and codec.decode(ids) == text


def test_bpe_pass_equals_plain_merges():
    rng = random.Random(6)
    for _ in range(60):
        pieces = list("abc") + ["ab", "bc", "abc", "ca", "▁", "▁a", "aa", "bb", "cab", "bca"]
        merges = rng.sample(pieces[3:6] + pieces[7:], 7)
        scored = [("<unk>", 0.0, 2)] + [(p, -float(i), NORMAL) for i, p in enumerate(merges + ["a", "b", "c", "▁"])]
        codec = Codec(scored, BPE)
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        assert codec.encode(text).tolist() == codec.merged("▁" + text)


def test_tables(spark, model):
    rows = edge_cases.rows()
    docs = edge_cases.documents(spark)
    got = piece_codec.encode_and_check(docs, PATH, ["doc_id", "text", "label"])
    assert all(r["ids"] == model.encode(r["text"] or "") and r["round_trip"] for r in got.collect())
    back = piece_codec.decode(piece_codec.encode(docs, PATH, ["doc_id"]), PATH, ["doc_id"]).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert piece_codec.encode(edge_cases.empty(spark), PATH, ["doc_id"]).collect() == []


def test_long_runs_of_spaces(model):
    """Runs are merged in about linear time; the library is asked on what it can do in reasonable time."""
    own = piece_codec.codec(PATH)
    for text in (" " * 5001, "a" + " " * 3000 + "b", ("  " * 700 + "x") * 3):
        assert own.encode(text).tolist() == model.encode(text)
    start = time.perf_counter()
    ids = own.encode("x" + " " * 1_000_000 + "y").tolist()
    assert time.perf_counter() - start < 60
    assert own.decode(ids) == "x" + " " * 1_000_000 + "y"
