import collections
import hashlib
import random
import re

import pytest

from tests.llm import edge_cases
from tidemark.llm import fingerprint


def documents_in_order(rows):
    distinct = {(r[0], r[1] or "") for r in rows}
    return sorted(distinct, key=lambda k: (k[0] is None, -(k[0] or 0)))


def jaccard(a, b):
    a, b = (collections.Counter(re.findall("[^\x20\x09-\x0d]+", t)) for t in (a, b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_edited_texts_and_likeness(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    rows = [(i * 7 % 501, " ".join(rng.choice(words) for _ in range(rng.randint(0, 150)))) for i in range(120)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = documents_in_order(rows)
    errors = []
    for k, (doc_id, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, following)]
    assert abs(sum(errors) / len(errors)) < 0.03
    assert sum(e * e for e in errors) / len(errors) < 0.01  # a quarter over the number of samples at most


@pytest.mark.parametrize("seed", [1, 2])
def test_edge_cases(spark, seed):
    rows = edge_cases.rows(seed)
    got = fingerprint.fingerprints(edge_cases.documents(spark, seed)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((r[0] is None, r[0] or 0, len(r[1] or "")) for r in rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    by_text = {}
    for r in got:
        if r["doc_id"] is not None:
            by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    assert by_text[""] == {""}


def test_one_row_follows_itself_and_no_rows(spark):
    (r,) = fingerprint.fingerprints(spark.createDataFrame([(1, "abcdef gh")], "doc_id long, text string")).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdef" + b"abc").hexdigest() and r["near_next"] == 1.0
    assert fingerprint.fingerprints(edge_cases.empty(spark)).collect() == []
