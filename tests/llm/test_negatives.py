import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives, queries_negatives

KEYS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int, chunk int, cluster string"


def brute(rows):
    """The contract, row by row: rows are (vec_id, embedding, label)."""
    own = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        row = (str(label), [math.floor(256 * v) for v in x])
        own[i] = min(own.get(i, row), row)
    out = []
    ids = sorted(own)
    matrix = np.array([own[i][1] for i in ids], dtype=np.int64)
    for a in ids:
        if a % 50:
            continue
        scores = dict(zip(ids, (matrix @ np.array(own[a][1], dtype=np.int64)).tolist(), strict=True))
        ranked = sorted((i for i in ids if i != a), key=lambda i: (-scores[i], i))
        for p in [i for i in ranked if own[i][0] == own[a][0]][:5]:
            fits = [i for i in ranked if own[i][0] != own[a][0] and 50 * scores[p] <= 100 * scores[i] <= 95 * scores[p]]
            out += [(a, p, n + 1, i, scores[p], scores[i]) for n, i in enumerate(fits[:3])]
    return sorted(out)


def got(df):
    assert df.columns == KEYS
    return sorted(tuple(r) for r in df.collect())


def mined(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.whole_vectors(table, moved, "embedding", 256), F.col("vec_id") % 50 == 0, **sizes)


def random_rows(n, dims, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dims))
    x = centres[rng.integers(0, 8, n)] + 0.6 * rng.standard_normal((n, dims))
    return [(i, [float(np.float32(v)) for v in x[i]], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize(("chunk", "block"), [(16384, 1024), (100, 3), (37, 1)])
def test_equals_brute_force(spark, chunk, block):
    rows = random_rows(700, 6)
    rng = random.Random(1)
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(60)]  # one vector many times
    rows += [(2000 + 50 * i, [0.0] * 6, 1) for i in range(3)] + [(50 * i, None, 1) for i in range(60, 64)]
    rows += [(3000, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (3050, [float("nan")] + [1.0] * 5, 1), (3100, [float("inf")] + [1.0] * 5, 1)]
    rows += [(3150, rows[3][1], None), (None, rows[3][1], 1), rows[50], rows[50], (100, rows[7][1], 0), (3200, [-0.001] * 6, 2)]
    rng.shuffle(rows)
    assert got(mined(spark, rows, chunk=chunk, block=block)) == brute(rows)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = got(queries_negatives.op13_hard_negatives(spark, sf_dir))
    assert found and found == brute(rows)


def test_few_rows(spark):
    assert got(mined(spark, [])) == []
    assert got(mined(spark, [(0, [1.0], 1)])) == []
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 2), (2, [0.7, 0.25], 2), (3, [1.0, 0.5], 1), (50, [-1.0, 0.5], 2)]
    assert got(mined(spark, rows)) == brute(rows)


def test_walks_end_early():
    """With clustered directions a walk looks at few pages, and finds what all pages give."""
    rng = np.random.default_rng(4)
    centre = np.zeros(16)
    centre[0] = 1.0
    near = lambda n: np.floor(256 * (3 * centre + 0.1 * rng.standard_normal((n, 16)))).astype(np.int64)
    far = np.floor(256 * (-centre + 0.2 * rng.standard_normal((20_000, 16)))).astype(np.int64)
    members, x = near(20), np.concatenate([far, near(400)])
    order, bound = negatives.shared_list(members, centre, x)
    asks = negatives.Asks(np.arange(20), np.full(20, -(1 << 62)), np.full(20, 1 << 62), 5, True)
    labels, x_labels, ids, x_ids = np.zeros(20, int), np.zeros(len(x), int), np.arange(20) - 100, np.arange(len(x))
    looked, kept = [], negatives.products
    negatives.products = lambda a, b, exact: looked.append(len(b)) or kept(a, b, exact)
    try:
        best = negatives.walk(members, labels, ids, asks, order, bound, x, x_labels, x_ids, True)
    finally:
        negatives.products = kept
    assert sum(looked) == negatives.PAGE
    scores = members @ x.T
    for i in range(20):
        want = np.lexsort((x_ids, -scores[i]))[:5]
        assert best[1][best[0] == i].tolist() == want.tolist()
    assert (negatives.products(members, x, False) == scores).all() and (negatives.products(members, x, True) == scores).all()
    assert (scores <= np.sqrt((members**2).sum(1))[:, None] * bound[np.argsort(order)][None, :]).all()


def test_blocks():
    cuts = negatives.blocks_of({0: 5, 1: 30, 2: 4, 3: 3, 4: 2}, 10)
    assert cuts == [(0, 0, 1), (1, 1, 3), (2, 4, 1), (3, 4, 1), (4, 4, 1)]
