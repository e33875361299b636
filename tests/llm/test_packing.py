import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import edge_cases
from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(1)
    pieces = [*"abcABC  ''.!é́ßİΣς中\xa0\x1c\t\n\x0b\x85 <|1２ñ̃ ", "'s ", "'ll ", "<|endoftext|>", "don't "]
    own = packing.word_ids(PATH)
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert own.text(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_sequences(spark, tokenizer, capacity):
    rows = edge_cases.rows()
    got = packing.pack_documents(edge_cases.documents(spark), PATH, capacity).collect()
    want = []
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want.append((r[0], n, at, len(cut), zlib.crc32(cut.tobytes())))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) <= -(-sum(r["length"] for r in got) // capacity) + 1


def test_blocks_are_packed_by_themselves(spark):
    items = spark.range(500).selectExpr("id as doc_id", "1 + id % 97 as length", "cast(id as int) as salt")
    got = packing.pack(items, 100, block_pieces=60).collect()
    assert len({r["sequence_id"] >> 32 for r in got}) > 3
    assert sorted(r["doc_id"] for r in got) == list(range(500))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_search_keeps_items_and_never_adds_bins(lengths):
    fit = packing.best_fit(lengths, 50)
    bins = packing.local_search([list(b) for b in fit], lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)
    assert -(-sum(lengths) // 50) <= len(bins) <= len(fit)


def test_search_empties_bins_that_best_fit_leaves():
    rng = random.Random(8)
    for _ in range(200):
        lengths = [rng.choice([3, 4, 5, 7, 9, 11, 13, 17]) for _ in range(rng.randint(6, 30))]
        spread = [[i] for i in range(len(lengths))]
        assert len(packing.local_search(spread, lengths, 30)) <= len(packing.best_fit(lengths, 30)) + 1
    # 8 + 4, 7 + 6 and 5 in bins of 15: exchanging 8 + 4 and 7 + 6 makes room for the last.
    assert len(packing.local_search([[0, 1], [2, 3], [4]], [8, 4, 7, 6, 5], 15)) == 2


def test_empty_table(spark):
    assert packing.pack_documents(edge_cases.empty(spark), PATH).collect() == []


def test_search_goes_on_while_bins_give_way():
    rng = random.Random(1)
    lengths = [rng.randint(400, 900) for _ in range(5000)]
    fit = packing.best_fit(lengths, 2048)
    bins = packing.local_search([list(b) for b in fit], lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(5000)) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)
    assert len(fit) == 1697 and len(bins) < 1640


def test_search_ends_without_an_exchange_left():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.randint(20, 45) for _ in range(rng.randint(5, 40))]
        bins = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
        if len(bins) == packing.least_bins(lengths, 100):
            continue
        fill = [sum(lengths[i] for i in b) for b in bins]
        parts = [set(packing._parts(b, lengths)) for b in bins]
        for a in range(len(bins)):
            for b in range(len(bins)):
                if a != b and fill[a] <= fill[b] < 100:
                    assert not any(0 < out - back <= 100 - fill[b] for out in parts[a] for back in parts[b])


def test_ids_of_sequences_are_those_of_the_documents(spark, tokenizer):
    docs = edge_cases.documents(spark)
    got = packing.sequences(packing.pack_documents(docs, PATH, 64)).collect()
    found, sizes = [], []
    for r in got:
        assert 0 < len(r["ids"]) <= 64 and [p["offset"] for p in r["pieces"]] == list(np.cumsum([0, *(p["length"] for p in r["pieces"])])[:-1])
        assert sum(p["length"] for p in r["pieces"]) == len(r["ids"])
        found += [(p["doc_id"], p["piece"], p["start"], tuple(r["ids"][p["offset"] : p["offset"] + p["length"]])) for p in r["pieces"]]
        sizes.append(r["sequence_id"])
    want = []
    for r in edge_cases.rows():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want += [(r[0], n, at, tuple(ids[at : at + 64])) for n, at in enumerate(range(0, len(ids), 64))]
    assert sorted(found, key=repr) == sorted(want, key=repr) and len(set(sizes)) == len(sizes)
    assert packing.sequences(packing.pack_documents(edge_cases.empty(spark), PATH)).collect() == []
