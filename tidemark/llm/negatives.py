"""Hard negatives: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels
within a band of scores below it.

A score is the integer inner product; higher ones come first, ties by smaller id. The result is exact.

Method, shared lists of anchor clusters: anchors are clustered by direction. For all members of a cluster and a
vector x, the inner product is at most |anchor| |x| cos(max(0, angle(x, centre) - spread)), with the largest angle
between a member and the centre as the spread. A cluster sorts its candidates by this bound once, and every member
walks the list, page by page, until the bound of what is left certifies that nothing better can come: first for the
positives, then for the negatives of all its positives at once.

Spark's part: clusters are bundled into blocks of at most ``ANCHORS`` members (larger clusters are cut), candidates
into chunks of about ``CHUNK``; a task has a block and a chunk, whatever the labels, so no label or direction that a
third of the rows share gathers in one task. Each task gives the best few of its chunk, and these meet per anchor.
Candidates are copied once per block: this is a stated query set against all rows, in blocks. Centres are fitted on
``SAMPLE`` anchors at most; they decide how soon a walk ends, never what it finds.

Defined results: rows with a null id, label or vector, or a null or not finite component take no part, nor do
vectors whose length is not the most frequent one. Of rows with the same id one counts, that of the least label and
vector; repeated rows count once. Vectors of zeros take part, with scores of 0. Ties go to the smaller id. Anchors
without positives and positives without negatives give no rows; nor does an empty table. Other columns take no part.
Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import written

SAMPLE = 8192
MEMBERS = 64  # anchors of a cluster, on average
CLUSTERS = 256  # at most
ANCHORS = 1024
CHUNK = 16384
PAGE = 1024
EXACT = float(1 << 53)


def whole_vectors(rows: DataFrame, label: str | Column, vector: str, scale: int) -> DataFrame:
    """``vec_id``, ``label`` (text) and ``vec``: whole numbers ``floor(scale * component)``, of the rows that take part."""
    x, label = F.col("vec"), F.col(label) if isinstance(label, str) else label
    fine = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vec")
    ).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    )
    size = fine.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("vec")
    one = fine.where(F.size("vec") == (size["n"] if size else 0)).select("vec_id", F.struct("label", whole).alias("row"))
    return one.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.vec")


# --- one block of anchors and one chunk of candidates ------------------------------


@dataclass
class Asks:
    """What is looked for: the ``k`` best candidates with ``low <= score <= high``, of the anchor's label or of others."""

    anchor: np.ndarray  # rows of the anchors' matrix
    low: np.ndarray
    high: np.ndarray
    k: int
    same_label: bool


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; a vector of zeros stays one."""
    length = np.sqrt((x**2).sum(1))
    return x / np.where(length > 0, length, 1)[:, None], length


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers; in double precision where that is exact."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else a @ b.T


def shared_list(members: np.ndarray, centre: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates by falling bound for any member of length one, and these bounds."""
    own, length = directions(members.astype(np.float64))
    unit, reach = directions(candidates.astype(np.float64))
    spread = np.arccos(np.clip(np.where(length > 0, own @ centre, 1), -1, 1)).max()
    angle = np.arccos(np.clip(unit @ centre, -1, 1))
    bound = reach * np.cos(np.maximum(0, angle - spread - 1e-7)) + 1e-6 * (1 + reach)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def walk(members: np.ndarray, labels: np.ndarray, ids: np.ndarray, asks: Asks, order, bound, x, x_labels, x_ids, exact: bool):
    """The best of a cluster's candidates for each ask: (ask, candidate, score), at most ``k`` each."""
    length = np.sqrt((members.astype(np.float64) ** 2).sum(1))
    least = asks.low.copy()  # below this nothing is wanted any more
    best: list[np.ndarray] = [np.empty(0, np.int64)] * 3  # ask, candidate, score
    open_ = np.arange(len(asks.anchor))
    for start in range(0, len(order), PAGE):
        open_ = open_[length[asks.anchor[open_]] * bound[start] >= least[open_]]
        if not len(open_):
            break
        page = order[start : start + PAGE]
        who, row = np.unique(asks.anchor[open_], return_inverse=True)
        score = products(members[who], x[page], exact)
        fits = labels[who][:, None] == x_labels[page][None, :]
        fits = (fits if asks.same_label else ~fits) & (ids[who][:, None] != x_ids[page][None, :])
        ask, at = np.nonzero(fits[row] & (score[row] >= least[open_, None]) & (score[row] <= asks.high[open_, None]))
        found = [open_[ask], page[at], score[row[ask], at]]
        best = first(*(np.concatenate(c) for c in zip(best, found, strict=True)), x_ids, asks.k)
        # Of asks that have enough, the last of their best is what must be reached.
        count = np.bincount(best[0], minlength=len(least))
        last = np.flatnonzero(np.diff(best[0], append=-1))
        full = last[count[best[0][last]] >= asks.k]
        least[best[0][full]] = np.maximum(least[best[0][full]], best[2][full])
    return best


def first(ask: np.ndarray, candidate: np.ndarray, score: np.ndarray, x_ids: np.ndarray, k: int) -> list[np.ndarray]:
    """The ``k`` best of each ask, in order."""
    order = np.lexsort((x_ids[candidate], -score, ask))
    ask, candidate, score = ask[order], candidate[order], score[order]
    place = np.arange(len(ask)) - np.searchsorted(ask, ask)
    return [c[place < k] for c in (ask, candidate, score)]


_FOUND = pa.schema([("anchor_id", pa.int64()), ("n", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _search(centres: np.ndarray, k: int, same_label: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Asks come with their anchors: a row per anchor, with the bounds of its asks as lists."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _FOUND.empty_table()
        dims = centres.shape[1]
        x, a = _matrix(left["vec"], dims), _matrix(right["vec"], dims)
        x_ids, ids = (np.asarray(t["vec_id"].combine_chunks()) for t in (left, right))
        _, codes = np.unique(np.array([*left["label"].to_pylist(), *right["label"].to_pylist()], dtype=object).astype(str), return_inverse=True)
        x_labels, labels = codes[: len(x)], codes[len(x) :]
        clusters = np.asarray(right["cluster"].combine_chunks())
        low, high = right["low"].to_pylist(), right["high"].to_pylist()
        most = [np.sqrt((m.astype(np.float64) ** 2).sum(1)).max() for m in (x, a)]
        out = []
        for cluster in np.unique(clusters).tolist():
            of = np.flatnonzero(clusters == cluster)
            order, bound = shared_list(a[of], centres[cluster], x)
            ask = [(i, n, lo, hi) for i, r in enumerate(of.tolist()) for n, (lo, hi) in enumerate(zip(low[r], high[r], strict=True))]
            if not ask:
                continue
            anchor, n, lows, highs = (np.array(c, np.int64) for c in zip(*ask, strict=True))
            asks = Asks(anchor, lows, highs, k, same_label)
            which, candidate, score = walk(a[of], labels[of], ids[of], asks, order, bound, x, x_labels, x_ids, most[0] * most[1] < EXACT)
            out.append((ids[of][anchor[which]], n[which].astype(np.int32), x_ids[candidate], score))
        if not out:
            return _FOUND.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_FOUND)

    return run


# --- Spark -----------------------------------------------------------------------


def fit(anchors: DataFrame, total: int, seed: int = 3) -> np.ndarray:
    """Unit centres of the anchors' directions, from the ``SAMPLE`` anchors with the smallest hashes."""
    sample = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").collect()
    x, _ = directions(np.array([r["vec"] for r in sample], np.float64))
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: max(1, min(CLUSTERS, total // MEMBERS, len(x)))]].copy()
    for _ in range(8):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.sqrt((sums**2).sum(1))
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def _clustered(centres: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(pa.chunked_array([batch["vec"]]), centres.shape[1])
                near = (x.astype(np.float64) @ centres.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=[*batch.schema.names, "cluster"])

    return run


def blocks_of(sizes: dict[int, int], most: int = ANCHORS) -> list[tuple[int, int, int]]:
    """For each cluster its first block and the number of blocks it is cut into; small ones share a block."""
    out, block, room = [], -1, 0
    for cluster, n in sorted(sizes.items()):
        cuts = -(-n // most)
        if cuts > 1 or n > room:
            out.append((cluster, block + 1, cuts))
            block += cuts
            room = 0 if cuts > 1 else most - n
        else:
            out.append((cluster, block, 1))
            room -= n
    return out


def mine(
    vectors: DataFrame, is_anchor: Column, k_positives: int = 5, k_negatives: int = 3, band: tuple[int, int] = (50, 95), chunk: int = CHUNK, block: int = ANCHORS
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score`` and ``negative_score``.

    ``vectors`` has ``vec_id``, ``label`` and whole numbers ``vec`` (``whole_vectors``); anchors are those rows for which
    ``is_anchor`` holds. For each of an anchor's ``k_positives`` best rows of its label, the ``k_negatives`` best of other
    labels that have ``band`` percent of the positive's score.
    """
    spark = vectors.sparkSession
    rows = written(vectors, "vectors")
    anchors = rows.where(is_anchor)
    total, n_rows = anchors.count(), rows.count()
    if not total:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    centres = fit(anchors, total)
    schema = "vec_id long, label string, vec array<bigint>, cluster int"
    clustered = written(anchors.mapInArrow(_clustered(centres), schema), "anchors")
    sizes = {r["cluster"]: r["count"] for r in clustered.groupBy("cluster").count().collect()}
    cuts = blocks_of(sizes, block)
    placed = F.broadcast(spark.createDataFrame(cuts, "cluster int, first int, cuts int"))
    n_blocks, n_chunks = cuts[-1][1] + cuts[-1][2], -(-n_rows // chunk)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(every(n_blocks).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks)).cast("int").alias("chunk"), "vec_id", "label", "vec")
    own = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("cuts"))).cast("int").alias("block")
    members = clustered.join(placed, "cluster").select(own, "vec_id", "label", "vec", "cluster")

    def searched(asking: DataFrame, k: int, same_label: bool) -> DataFrame:
        asking = asking.select("block", every(n_chunks).alias("chunk"), "vec_id", "label", "vec", "cluster", "low", "high")
        by = ["block", "chunk"]
        found = candidates.groupBy(*by).cogroup(asking.groupBy(*by)).applyInArrow(_search(centres, k, same_label), "anchor_id long, n int, vec_id long, score long")
        best = Window.partitionBy("anchor_id", "n").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    any_score = [F.array(F.lit(v)).alias(c) for c, v in (("low", -(1 << 62)), ("high", 1 << 62))]
    positives = written(searched(members.select("*", *any_score), k_positives, True), "positives")
    # floor and ceiling of a percentage of a whole number
    low = -F.expr(f"(-score * {band[0]} - pmod(-score * {band[0]}, 100)) div 100")
    high = F.expr(f"(score * {band[1]} - pmod(score * {band[1]}, 100)) div 100")
    bands = positives.select("anchor_id", F.struct("rank", low.cast("long").alias("low"), high.cast("long").alias("high")).alias("b"))
    bands = bands.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list("b")).alias("b"))
    asking = members.join(bands, "vec_id").select("block", "vec_id", "label", "vec", "cluster", F.col("b.low").alias("low"), F.col("b.high").alias("high"))
    negatives = searched(asking, k_negatives, False).select("anchor_id", (F.col("n") + 1).alias("of"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = positives.select("anchor_id", F.col("rank").alias("of"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return known.join(negatives, ["anchor_id", "of"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
