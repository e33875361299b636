"""Approximate nearest neighbours by largest inner product: probed lists, scanned by an adaptive number of dimensions.

Vectors are dealt to the lists of their nearest centroids (k-means on a
bounded sample). A query probes its nearest lists. Within a list, vectors and
queries are rotated at random and compared by blocks of columns: after each
block, a hypothesis test on the partial distance tells which candidates can
hardly reach the query's present bound, and these are abandoned. Survivors get
the exact inner product of the original vectors in double precision.

The number of lists probed is the smallest that finds ``TARGET`` of the
neighbours within the sample, so data without clusters are probed widely; a
query probes further lists until these hold as many vectors as are wanted. The
bound starts from the sample's members in the probed lists; the sample holds
each vector once. A query for which fewer vectors come back than are wanted is
searched again in its lists, exactly and without a bound.

Of equal vectors only the ``k + 1`` with the smallest ids can be among a
query's ``k`` nearest, so no more are searched, and equal queries are searched
once. Lists are bundled, or cut into chunks where they are large, and their queries
cut into blocks, so that no task grows with the data.

Defined results: vectors that are null or zero, or hold a null or a component
that is not finite, take no part, nor do rows without id or vectors whose
length is not the most frequent one. Rows with the query's id are its own.
Repeated rows count once. Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import written

# Bounds of the sample that centroids, probes and first bounds are made from.
SAMPLE_ROWS = 8192
SEEDS = 4096
TARGET = 0.96
LEAST = 50  # times the neighbours wanted: candidates that are probed at least, on average
BLOCK = 16  # columns looked at between two tests
EPSILON = 1.4  # of the test, two standard deviations; larger abandons later
CHUNK = 8192  # vectors that are searched together: several lists, or a part of a large one
QUERY_BLOCK = 1024
GROUPS = 24  # of vectors and queries, at least, if there are queries enough


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int
    seeds: np.ndarray
    seed_list: np.ndarray

    def lists(self, vectors: np.ndarray) -> np.ndarray:
        """Lists by rising distance of their centroids."""
        return np.argsort((self.centroids**2).sum(1) - 2 * vectors @ self.centroids.T, axis=1, kind="stable")

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Lists by falling inner product with their centroids."""
        return np.argsort(-(vectors @ self.centroids.T), axis=1, kind="stable")

    def bounds(self, vectors: np.ndarray, k: int) -> np.ndarray:
        """For each query a value that ``2 * k`` different vectors in its probed lists reach, or minus infinity."""
        open_ = np.zeros((len(vectors), len(self.centroids)), bool)
        np.put_along_axis(open_, self.order(vectors)[:, : self.probes], True, axis=1)
        score = np.where(open_[:, self.seed_list], vectors @ self.seeds.T, -np.inf)
        if score.shape[1] < 2 * k:
            return np.full(len(vectors), -np.inf)
        return np.partition(score, -2 * k, axis=1)[:, -2 * k]


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """``vec_id`` and ``vec`` (an array of doubles) of the vectors that take part."""
    x = F.col("vec")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).where(
        F.col("vec_id").isNotNull()
        & x.isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists(x, lambda v: v != 0)
    )
    size = fine.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return fine.where(F.size("vec") == (size["n"] if size else 0)).dropDuplicates(["vec_id", "vec"]).withColumn("key", F.xxhash64("vec"))


def fit(vectors: DataFrame, k: int, seed: int = 5) -> Index | None:
    """An index from the ``SAMPLE_ROWS`` vectors with the smallest hashes, of rows numbered by ``n`` among equal vectors.

    None without vectors. Equal vectors count once in the sample: copies would be centroids of empty lists, and bounds
    that nothing but the copies reaches.
    """
    total = vectors.count()
    if not total:
        return None
    sample = vectors.where("n = 1").orderBy("key", "vec_id").limit(SAMPLE_ROWS).select("vec").collect()
    x = np.array([r["vec"] for r in sample])
    rng = np.random.default_rng(seed)
    n_lists = int(min(max(1, np.sqrt(total) / 2), 1024, max(1, len(x) // 8)))
    centroids = x[rng.permutation(len(x))[:n_lists]].copy()
    for _ in range(10):
        near = ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)
        count = np.bincount(near, minlength=n_lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    near = ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)
    # The fewest probes that find TARGET of the sample's own neighbours.
    asked = x[:256]
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    rank = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    place = np.take_along_axis(rank, near[best], axis=1)
    probes = n_lists if not place.size else int(np.quantile(place, TARGET, method="higher")) + 1
    probes = min(n_lists, max(probes, -(-LEAST * k * n_lists // total)))
    return Index(centroids, rotation, probes, x[:SEEDS], near[:SEEDS])


_CANDIDATE = pa.schema([("list", pa.int32()), ("vec_id", pa.int64()), ("data", pa.binary())])
_PROBE = pa.schema([("bundle", pa.int32()), ("key", pa.int64()), ("bound", pa.float64()), ("lists", pa.binary()), ("data", pa.binary())])
_FOUND = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(batch, dims: int) -> np.ndarray:
    return batch["vec"].flatten().to_numpy().reshape(-1, dims)


def _listed(index: Index):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, index.centroids.shape[1])
                lists = index.lists(x)[:, 0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(lists), batch["vec_id"], pa.array([v.tobytes() for v in x], pa.binary())], schema=_CANDIDATE)

    return run


def _probing(index: Index, k: int, bundle_of: np.ndarray, sizes: np.ndarray):
    """The probed lists of each query, at least so many that they hold ``k`` vectors if there are as many."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                x = _matrix(part, index.centroids.shape[1])
                rows, order = [], index.order(x).astype(np.int32)
                probes = np.maximum(index.probes, (sizes[order].cumsum(1) < k).sum(1) + 1)
                for key, vector, bound, lists, n in zip(part["key"].to_pylist(), x, index.bounds(x, k), order, probes.tolist(), strict=True):
                    lists = lists[:n]
                    bundles = bundle_of[lists]
                    rows += [(b, key, bound, lists[bundles == b].tobytes(), vector.tobytes()) for b in np.unique(bundles).tolist() if b >= 0]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_PROBE)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PROBE, strict=True)], schema=_PROBE)

    return run


def bundles_of(sizes: dict[int, int], index: Index) -> tuple[np.ndarray, dict[int, int]]:
    """A bundle for each list (-1 for an empty one), and each bundle's number of vectors.

    Lists along the main direction of the centroids share a bundle up to ``CHUNK`` vectors; a larger list has its own.
    """
    centred = index.centroids - index.centroids.mean(0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
    bundle_of, total, bundle = np.full(len(along), -1), {}, -1
    for i in np.argsort(along, kind="stable").tolist():
        if n := sizes.get(i, 0):
            if bundle < 0 or total[bundle] + n > CHUNK:
                bundle += 1
            bundle_of[i] = bundle
            total[bundle] = total.get(bundle, 0) + n
    return bundle_of, total


def scan(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, bounds: np.ndarray, rotation: np.ndarray, k: int):
    """Per query, candidates that may be among its ``k`` nearest: (query row, id, score).

    A candidate x reaches the bound s of a query q if |q - x|^2 <= |q|^2 + |x|^2 - 2 s. From the first d of D rotated
    columns the distance is estimated as D / d times the partial one; the test lets it exceed the limit by a factor for
    chance. With the partial inner product p, that is p - a(x) >= b(q).
    """
    dims = vectors.shape[1]
    q, x = queries @ rotation, vectors @ rotation
    q_all, x_all = (q**2).sum(1) - 2 * np.maximum(bounds, -1e30), (x**2).sum(1)
    rows = columns = product = None
    # Sums in single precision may differ by so much; candidates at the limit itself must not be lost by it.
    slack = 1e-4 * (1 + np.sqrt(np.abs(x_all).max(initial=0)) * np.sqrt((q**2).sum(1)))
    dense = np.zeros((len(q), len(x)), np.float32)
    q32, x32 = q.astype(np.float32), x.astype(np.float32)
    for start in range(0, dims, BLOCK):
        end = min(start + BLOCK, dims)
        if rows is None:
            dense += q32[:, start:end] @ x32[:, start:end].T
        else:
            product = product + (q32[rows, start:end] * x32[columns, start:end]).sum(1)
        if end == dims:
            break
        chance = (1 + EPSILON * np.sqrt((1 - end / dims) / end)) ** 2 * end / dims
        a = (((x[:, :end] ** 2).sum(1) - chance * x_all) / 2).astype(np.float32)
        b = (((q[:, :end] ** 2).sum(1) - chance * q_all) / 2 - slack).astype(np.float32)
        if rows is None:
            alive = dense >= b[:, None] + a[None]
            if np.count_nonzero(alive) < 0.15 * alive.size:  # from here on pair by pair
                rows, columns = np.nonzero(alive)
                product = dense[rows, columns]
        else:
            alive = product >= b[rows] + a[columns]
            rows, columns, product = rows[alive], columns[alive], product[alive]
    # What is left must come near the bound in single precision before it is computed in double precision.
    least = (bounds - slack).astype(np.float32)
    if rows is None:
        rows, columns = np.nonzero(dense >= least[:, None])
    else:
        alive = product >= least[rows]
        rows, columns = rows[alive], columns[alive]
    score = np.empty(len(rows))
    for at in range(0, len(rows), 65536):
        part = slice(at, at + 65536)
        score[part] = (queries[rows[part]] * vectors[columns[part]]).sum(1)
    return _first(rows, ids[columns], score, len(queries), k)


def scan_all(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """Per query, its ``k`` nearest of all candidates, none abandoned: (query row, id, score)."""
    found = []
    for row, query in enumerate(queries):
        score = (query * vectors).sum(1)
        best = np.lexsort((ids, -score))[:k]
        found.append((np.full(len(best), row), ids[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _first(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, n: int, k: int):
    """The ``k`` best of each of ``n`` query rows, ties by id."""
    order = np.lexsort((ids, -score, rows))
    rows, ids, score = rows[order], ids[order], score[order]
    near = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows] < k
    return rows[near], ids[near], score[near]


def _search(index: Index, k: int):
    dims = index.centroids.shape[1]

    def run(candidates: pa.Table, probes: pa.Table) -> pa.Table:
        if not (candidates.num_rows and probes.num_rows):
            return _FOUND.empty_table()
        x, q = (np.frombuffer(b"".join(t["data"].to_pylist()), np.float64).reshape(-1, dims) for t in (candidates, probes))
        lists, ids = (np.asarray(candidates[c].combine_chunks()) for c in ("list", "vec_id"))
        keys, bounds = (np.asarray(probes[c].combine_chunks()) for c in ("key", "bound"))
        asks = [set(np.frombuffer(b, np.int32).tolist()) for b in probes["lists"].to_pylist()]
        found = []
        for one in np.unique(lists).tolist():
            of_list, asking = np.flatnonzero(lists == one), np.array([i for i, a in enumerate(asks) if one in a], np.int64)
            free = np.isneginf(bounds[asking])
            if len(bound := asking[~free]):
                rows, near, score = scan(q[bound], x[of_list], ids[of_list], bounds[bound], index.rotation, k)
                found.append((bound[rows], near, score))
            if len(free := asking[free]):
                rows, near, score = scan_all(q[free], x[of_list], ids[of_list], k)
                found.append((free[rows], near, score))
        if not found:
            return _FOUND.empty_table()
        rows, near, score = _first(*(np.concatenate(c) for c in zip(*found, strict=True)), len(q), k)
        return pa.Table.from_arrays([pa.array(keys[rows]), pa.array(near), pa.array(score)], schema=_FOUND)

    return run


def search(vectors: DataFrame, is_query, k: int = 20, vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest found of each query.

    Queries are the usable rows for which the column expression ``is_query`` holds.
    """
    spark = vectors.sparkSession
    fine = usable(vectors, vector)
    smallest = Window.partitionBy("key").orderBy("vec_id")
    few = fine.withColumn("n", F.row_number().over(smallest)).where(f"n <= {k + 1}")
    index = fit(few, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    listed = few.select("vec_id", "vec").mapInArrow(_listed(index), "list int, vec_id long, data binary")
    queries = fine.where(is_query).select("key", F.col("vec_id").alias("query_id"), "vec")
    # Bundles of lists and their blocks of queries; a row per list at most reaches the driver.
    sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}
    bundle_of, total = bundles_of(sizes, index)
    held = np.array([sizes.get(i, 0) for i in range(len(bundle_of))])
    asked = queries.dropDuplicates(["key"]).select("key", "vec").mapInArrow(
        _probing(index, k + 1, bundle_of, held), "bundle int, key long, bound double, lists binary, data binary"
    )
    asking = {r["bundle"]: r["count"] for r in asked.groupBy("bundle").count().collect()}
    least = -(-GROUPS // max(1, len(asking)))
    cuts = [(b, -(-total[b] // CHUNK), max(-(-n // QUERY_BLOCK), min(-(-n // 16), least))) for b, n in asking.items()]
    cuts = F.broadcast(spark.createDataFrame(cuts, "bundle int, chunks int, blocks int"))
    in_bundle = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(bundle_of) if b >= 0], "list int, bundle int"))
    left = listed.join(in_bundle, "list").join(cuts, "bundle").select(
        "bundle", F.expr("cast(pmod(xxhash64(vec_id), chunks) as int)").alias("chunk"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "list", "vec_id", "data"
    )
    by = ["bundle", "chunk", "block"]
    nearest = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")

    def searched(asked: DataFrame) -> DataFrame:
        right = asked.join(cuts, "bundle").select(
            "bundle", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.expr("cast(pmod(xxhash64(key), blocks) as int)").alias("block"), "key", "bound", "lists", "data"
        )
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(index, k + 1), "key long, vec_id long, score double")
        return found.withColumn("n", F.row_number().over(nearest)).where(f"n <= {k + 1}").drop("n")

    found = written(searched(asked), "nearest")
    # Queries for which less came back than their lists hold are searched again without a bound.
    wanted = min(k + 1, int(held.sum()))
    enough = found.groupBy("key").count().where(f"count >= {wanted}").select("key")
    short = written(queries.select("key").distinct().join(enough, "key", "left_anti"), "short")
    if short.head(1):
        again = searched(asked.join(short, "key", "left_semi").withColumn("bound", F.lit(float("-inf"))))
        found = found.join(short, "key", "left_anti").unionByName(again)
    others = queries.select("key", "query_id").join(found, "key").where("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return others.withColumn("rank", F.row_number().over(ranked)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
