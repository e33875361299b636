import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import edge_cases
from tidemark.llm import substring
from tidemark.llm import words as W


def brute(rows, window):
    """(n_words, n_removed, kept words) by (doc_id, text), documents in order of id (none last), then text."""
    seen, out = set(), {}
    for key in sorted({(r[0], r[1] or "") for r in rows}, key=lambda k: (k[0] is None, k[0] or 0, k[1].encode())):
        words = re.findall("[^\x20\x09-\x0d]+", key[1])
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            gram = tuple(words[s : s + window])
            if gram in seen:
                gone[s : s + window] = [True] * window
            seen.add(gram)
        out[key] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("window", "edge"), [(20, 8), (5, 2), (3, 3), (1, 1)])
def test_equals_brute_force(spark, window, edge):
    rows = edge_cases.rows()
    got = substring.dedup(edge_cases.documents(spark), ["text", "label"], window, edge).collect()
    want = brute(rows, window)
    assert len(got) == len(rows)
    for r in got:
        n, removed, kept = want[r["doc_id"], r["text"] or ""]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())
        assert sum(s["end"] - s["start"] for s in r["spans"]) == removed
    assert any(r["n_removed"] for r in got)


def test_texts_without_cuts_stay_as_they_are(spark):
    got = substring.dedup(edge_cases.documents(spark), ["text"], texts=True).collect()
    for r in got:
        if not r["n_removed"]:
            assert r["kept_text"] == (r["text"] or "")


def test_periodic_text_and_one_hot_passage(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(60)] + [(100, "a b " * 500)]
    got = {r["doc_id"]: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 30 for i in range(1, 60))
    want = brute(rows, 20)
    assert got[100]["n_removed"] == want[100, rows[-1][1]][1] > 900


def test_empty_table(spark):
    assert substring.dedup(edge_cases.empty(spark)).collect() == []


def test_edge_longer_than_window(spark):
    with pytest.raises(ValueError):
        substring.dedup(edge_cases.empty(spark), window=4, edge=5)


def test_paths_are_the_longest_runs_without_branches(spark):
    # Two sources share a middle; the second part of the first one occurs once more, by itself.
    a, b, c = ([f"{x}{i}" for i in range(30)] for x in "abc")
    texts = [a + b + c, ["x"] + b + ["y"], ["z", *a, *b, *c, "z"], [*c[10:], "q"]]
    rows = [(1, 0, i, " ".join(t)) for i, t in enumerate(texts)]
    docs = pa.Table.from_pylist([{"batch": 0, "doc_id": i, "text": t} for _, _, i, t in rows])
    batch = substring._Batch(docs, 5, 5)
    sent = substring._edge_pass(1, 5, 5)(docs, _all_repeat(batch))
    edges = substring._repeated_edges(sent.slice(0, 1))
    paths = substring.paths_of(spark.createDataFrame(edges.to_pandas())).orderBy("place").collect()
    got = [(p["place"], p["n"]) for p in paths]
    # a's windows, those over a|b, b's, those over b|c with c's first ten words, the rest of c.
    assert [(batch.said(place, 1).decode(), n) for place, n in got] == [("a0", 30), ("b0", 26), ("b26", 14), ("c10", 16)]
    assert {p["batch"] for p in paths} == {0} and len({p["path"] for p in paths}) == 4


def _all_repeat(batch):
    found, _ = batch.anchors()
    return pa.Table.from_pylist([{"batch": 0, "bucket": 0, "bits": substring.R.pack_bits(np.ones(len(found), bool))}])


def test_windows_with_equal_hashes_and_other_words_stay():
    text = " ".join(f"w{i}" for i in range(12))
    docs = pa.Table.from_pylist([{"batch": 0, "doc_id": 1, "text": f"a  {text}\tb"}, {"batch": 0, "doc_id": 2, "text": text}])
    batch = substring._Batch(docs, 5, 5)
    assert batch.said(0, 3) == b"a w0 w1" and batch.said(13, 99) == b"b " + text.encode()
    assert substring._differs(batch, 1, 8, text.encode(), 5) == []
    own, real = batch.words, W.word_hashes
    try:  # as if the word before the last had the hash of another one
        W.word_hashes = lambda texts: (own[1:13], None)
        assert substring._differs(batch, 1, 8, text.replace("w10", "other").encode(), 5) == [7, 8]
    finally:
        W.word_hashes = real


def test_long_shared_texts_over_many_batches_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring, "BATCH_CHARS", 900)
    monkeypatch.setattr(substring, "BUCKET_HASHES", 300)
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(80):
        source, s = rng.choice(base), rng.randrange(90)
        words = [f"own{i}", *source[s : s + rng.randrange(5, 60)], *rng.choice(base)[:15], *source[s : s + 12]]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "odd"
        rows.append((i, "  ".join(words)))
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], 8, 4).collect()
    want = brute(rows, 8)
    assert sum(r["n_removed"] for r in got) > 1000
    for r in got:
        n, removed, kept = want[r["doc_id"], r["text"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())


def test_shuffled_texts_and_edges_are_used_again(spark):
    docs = spark.createDataFrame([(i, "some words " * 30) for i in range(20)], "doc_id long, text string")
    cut = substring.dedup(docs)
    cut.collect()
    plan = cut._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 4
