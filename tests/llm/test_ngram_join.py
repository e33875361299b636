import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tests.llm import edge_cases
from tidemark.llm import ngram_join
from tidemark.llm.ngram_join import Likeness

FOLD = {i: i + 32 for i in range(65, 91)}


def brute(rows, k, percent):
    """Per row (n_shingles, component) by comparing all pairs."""
    sets = []
    for r in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (r[1] or "").translate(FOLD))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shingle", "percent"), [(3, 90), (5, 80), (1, 70), (2, 100)])
def test_equals_all_pairs(spark, shingle, percent):
    rows = edge_cases.rows()
    got = ngram_join.join(edge_cases.documents(spark), Likeness(shingle, percent)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, shingle, percent)


def chain(n, seed=3, size=60, step=2):
    """Texts of which each differs a little from one before it."""
    rng = random.Random(seed)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(size)]]
    while len(texts) < n:
        text = list(rng.choice(texts[-8:]))
        for _ in range(rng.randint(0, step)):
            text[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
        texts.append(text)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_large_cluster_is_searched_by_leaves(spark, monkeypatch, percent):
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    rows = chain(150, step=4)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), Likeness(1, percent)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 1, percent)


def test_many_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1200):
        text = list(base)
        text[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), Likeness(3, 90)).collect()
    assert {r["component_id"] for r in got} == {0}


def meet(a, b):
    """Do two sets share as many cells of a band as both of them ask for?"""
    return any(len(set(x.tolist()) & set(y.tolist())) >= max(m, n) for x, m in a for y, n in b)


def test_tree_keeps_every_pair_that_links():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, 80, dtype=np.uint64)
        for cut in (0, 3, 8, 15):
            sets.append(np.unique(np.r_[base[cut:], rng.integers(0, 2**63, cut, dtype=np.uint64)]))
    for percent in (70, 80, 90):
        like = Likeness(3, percent)
        size = np.array([len(s) for s in sets])
        found = {frozenset((i, int(j))) for i, js in enumerate(ngram_join.surviving(ngram_join.points(sets), size, like)) for j in js}
        bands = like.bands(int(size.max()))
        cells = [ngram_join.cells(s, like, bands) for s in sets]
        linked = 0
        for i in range(len(sets)):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if like.links(np.array(common), size[i], size[j]):
                    linked += 1
                    assert frozenset((i, j)) in found and meet(cells[i], cells[j])
        assert linked


@pytest.mark.parametrize("percent", [70, 80, 90, 100])
def test_linked_sets_of_any_size_share_a_cell(percent):
    rng, like = np.random.default_rng(6), Likeness(3, percent)
    bands = like.bands(3000)
    for size in [*range(1, 60), 100, 333, 1000, 2500]:
        for _ in range(8):
            a = rng.choice(2**62, size, replace=False).astype(np.uint64)
            most = like.differing(size)
            drop = int(rng.integers(0, min(most, size - 1) + 1))
            b = np.unique(np.r_[a[drop:], rng.choice(2**62, int(rng.integers(0, most - drop + 1)), replace=False).astype(np.uint64)])
            a = np.unique(a)
            if like.links(np.array(len(np.intersect1d(a, b))), len(a), len(b)):
                assert meet(ngram_join.cells(a, like, bands), ngram_join.cells(b, like, bands))


@pytest.mark.parametrize("size", [9, 13, 16, 24, 40, 80])
def test_small_sets_without_common_shingles_share_no_cell(size):
    rng, like = np.random.default_rng(7), Likeness(5, 80)
    bands = like.bands(200)
    own = [ngram_join.cells(rng.choice(2**62, size, replace=False).astype(np.uint64) * np.uint64(4), like, bands) for _ in range(400)]
    for of_band in zip(*own, strict=True):
        values = np.concatenate([c for c, _ in of_band])
        assert len(np.unique(values)) == len(values)


def test_a_line_that_all_texts_have_does_not_make_one_cluster(spark, monkeypatch):
    tables, write = {}, ngram_join.written

    def written(df, label):
        tables[label] = write(df, label)
        return tables[label]

    monkeypatch.setattr(ngram_join, "written", written)
    line, rows = [f"c{i}" for i in range(30)], []
    for i in range(300):
        text = [f"w{i}_{j}" for j in range(120)]
        rows += [(2 * i, " ".join(text + line)), (2 * i + 1, " ".join([*text[:60], "other", *text[61:], *line]))]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), Likeness(5, 80)).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got) and len(got) == 600
    members = tables["placed"].groupBy("label").count().collect()
    assert len(members) == 300 and all(r["count"] == 2 for r in members)


def test_rarity_is_the_same_for_all_batches():
    rng = np.random.default_rng(8)
    found = [np.unique(rng.integers(0, 60, n).astype(np.uint64) * np.uint64(2**58)) for n in (20, 40, 60, 0, 7)]
    many = [rng.random(len(f)) < 0.2 for f in found]
    sent = pa.concat_tables([ngram_join.R.send(b, f, m, 3, [(-1 - b, b"kept")]) for b, (f, m) in enumerate(zip(found, many, strict=True))])
    said = [[] for _ in found]
    for bucket in set(sent["bucket"].to_pylist()):
        for row in ngram_join._rarities(sent.filter(pc.equal(sent["bucket"], bucket))).to_pylist():
            said[row["batch"]].append((row["bucket"], row["bits"]))
    times = Counter(x for f, m in zip(found, many, strict=True) for x in [*f.tolist(), *f[m].tolist()])
    for b, answers in enumerate(said):
        answers = dict(answers)
        assert answers.pop(-1 - b) == b"kept"
        rarity = ngram_join._rarity_of(found[b], list(answers.items()), 3)
        assert rarity.tolist() == [(times[x] - 1).bit_length() for x in found[b].tolist()]


def test_keep_first(spark):
    rows = edge_cases.rows()
    docs = edge_cases.documents(spark)
    kept = ngram_join.keep_first(docs, Likeness(5, 80))
    assert kept.columns == docs.columns
    component = {(d, n): c for d, n, c in brute(rows, 5, 80)}
    first = {d for (d, _), c in component.items() if d == c}
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(d for d in first if d is not None)


def test_empty_tables(spark):
    assert ngram_join.join(edge_cases.empty(spark)).collect() == []
    only_blank = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.join(only_blank).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
