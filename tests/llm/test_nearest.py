import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, score double, rank int"


def table(spark, ids, vectors):
    return spark.createDataFrame([(int(i) if i is not None else None, None if v is None else [None if x is None else float(x) for x in v], 1.0, 2) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(ids, x, asked, k):
    out = {}
    for i in asked:
        score = x @ x[ids == i][0]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_on_clustered_and_on_scattered_vectors(spark):
    rng = np.random.default_rng(1)
    for centres in (rng.standard_normal((25, 24)) * 2, np.zeros((25, 24))):
        x = (centres[rng.integers(0, 25, 1500)] + rng.standard_normal((1500, 24))).astype(np.float32).astype(float)
        ids = rng.permutation(1500)
        got, want = found(nearest.search(table(spark, ids, x), F.col("vec_id") % 20 == 0)), brute(ids, x, ids[ids % 20 == 0], 20)
        assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits / (20 * len(want)) > 0.9
        exact = {(q, int(j)): float(x[ids == j][0] @ x[ids == q][0]) for q in got for j, _ in got[q]}
        assert all(abs(exact[q, j] - s) < 1e-12 for q in got for j, s in got[q])


def test_ties_copies_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((60, 4)), 1)
    x[10:50] = x[10]  # a large group of equal vectors
    ids = np.arange(60) * 5
    odd = [(1000, None), (1020, [0, 0, 0, 0]), (1040, [1, None, 1, 1]), (1060, [1, float("nan"), 1, 1]), (1080, [float("inf"), 1, 1, 1]), (1100, [1.0, 2.0]), (None, [1, 1, 1, 1]), (1120, [])]
    rows = table(spark, [*ids, *(i for i, _ in odd), 0], [*x, *(v for _, v in odd), x[0]])
    got = found(nearest.search(rows, F.col("vec_id") % 20 == 0, k=7))
    x32 = x.astype(np.float32).astype(float)
    want = brute(ids, x32, ids[ids % 20 == 0], 7)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert set(got) == set(want)


def test_small_and_empty_tables(spark):
    assert nearest.search(table(spark, [], []), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest.search(table(spark, [20], [[0, 0]]), F.col("vec_id") % 20 == 0).collect() == []
    assert found(nearest.search(table(spark, [20], [[1, 2]]), F.col("vec_id") % 20 == 0)) == {}
    assert found(nearest.search(table(spark, [20, 3], [[1, 2], [3, 4]]), F.col("vec_id") % 20 == 0)) == {20: [(3, 11.0)]}


def test_scan_abandons_only_what_can_hardly_be_near():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((20, 64))
    rotation = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    true = np.sort(q @ x.T, axis=1)[:, ::-1]
    rows, ids, score = nearest.scan(q, x, np.arange(3000), true[:, 39], rotation, 20)
    hits = sum(len(set(ids[rows == r]) & set(np.argsort(-(q[r] @ x.T))[:20])) for r in range(20))
    assert hits > 0.97 * 400


def test_groups_of_equal_vectors_keep_their_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    for group in range(10):
        x[60 * group : 60 * group + 60] = x[60 * group]
    ids = rng.permutation(900)
    got, want = found(nearest.search(table(spark, ids, x), F.col("vec_id") % 20 == 0)), brute(ids, x, ids[ids % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    copies = [q for q in want if np.flatnonzero(ids == q)[0] < 600]
    assert copies and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in copies)


def test_one_vector_of_nearly_all_rows_leaves_nobody_short(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 16)).astype(np.float32).astype(float)
    x[:1900] = x[0]
    ids = rng.permutation(2000)
    got = found(nearest.search(table(spark, ids, x), F.col("vec_id") % 10 == 0))
    assert set(got) == {int(i) for i in ids if i % 10 == 0} and all(len(v) == 20 for v in got.values())


def test_scan_keeps_copies_at_the_bound_itself():
    rng = np.random.default_rng(6)
    rotation = np.linalg.qr(rng.standard_normal((128, 128)))[0]
    q = rng.standard_normal((30, 128))
    q = (q / np.linalg.norm(q, axis=1)[:, None]).astype(np.float32).astype(float)
    x = np.vstack([np.repeat(q, 21, axis=0), rng.standard_normal((2000, 128)) / np.sqrt(128)])
    bounds = np.partition(q @ np.repeat(q, 60, axis=0).T, -42, axis=1)[:, -42]
    rows, ids, _ = nearest.scan(q, x, np.arange(len(x)), bounds, rotation, 21)
    assert all(ids[rows == i].tolist() == list(range(21 * i, 21 * i + 21)) for i in range(30))


def test_bounds_come_from_different_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, 16)).astype(np.float32).astype(float)
    x[:300] = x[0]
    rows = nearest.usable(table(spark, np.arange(600), x), "embedding")
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where("n <= 21")
    index = nearest.fit(numbered, 20)
    assert len(np.unique(index.seeds, axis=0)) == len(index.seeds) == 301
    assert index.bounds(x[:1], 21)[0] < (x[0] ** 2).sum() - 1e-3


def test_scan_all_abandons_nobody_and_breaks_ties_by_id():
    x = np.array([[1.0, 0], [0, 1], [1, 0], [-1, 0]])
    rows, ids, score = nearest.scan_all(np.array([[1.0, 0], [0, 2]]), x, np.array([9, 5, 3, 4]), 3)
    assert list(zip(rows.tolist(), ids.tolist(), score.tolist(), strict=True)) == [(0, 3, 1), (0, 9, 1), (0, 5, 0), (1, 5, 2), (1, 3, 0), (1, 4, 0)]
