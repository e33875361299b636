"""N-gram Jaccard join: documents whose sets of word shingles are similar, as connected components.

Method: the shingles of a set are hashed into groups, and a set is the point
of its group counts. The intersection of two sets is at most the sum of the
smaller counts of each group, so similar sets have near points.

1. Sets of about the same size share a band. In a band, the groups form blocks
   of coordinates. Similar sets differ in a bounded number of shingles, and
   there are more blocks than that, so their points agree in all coordinates
   of many blocks: they meet in as many cells (the band, the block, a hash of
   its counts). Only sets with so many cells that hold other sets are followed
   up, by the rarest of these cells, so that what many texts have in common,
   such as a line of theirs, doesn't put them into one cluster.
2. In a cell, the sum of coordinate minima bounds the overlap of each pair.
   Pairs that survive put sets into the same candidate cluster.
3. A cluster is searched by a count-vector R-tree: boxes of points are
   compared by the sum of the minima of their upper corners, then points, and
   the surviving pairs are verified on the sets themselves. Pairs already
   linked through others need no verification, so a large group of near copies
   costs about one comparison per copy.
4. A cluster beyond ``LEAF`` sets is dealt into leaves. Each leaf is searched
   together with the first one; what is then not in the cluster's largest
   component is searched against all leaves, in blocks. No pair is lost and no
   task holds more than two leaves.

Equal sets are one node from the start. Spark deals, counts, joins and finds
the components; tasks work on packed arrays of bounded size.

Defined results: only A-Z are lower-cased; words are separated by ASCII white
space. A document with fewer words than a shingle has its whole sequence as
its one shingle; without words (or with a null text) its set is empty and it
is linked with nothing, not even with other empty ones. Repeated rows are
equal sets. The component of documents without id is null unless one of them
has an id; an unlinked document has its own id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import repeats as R
from tidemark.llm import words as W
from tidemark.llm.arrow import map_texts
from tidemark.llm.components import components, written
from tidemark.session import parallelism

SHINGLE = 5
PERCENT = 80
LEAF = 512
BATCH_CHARS = 1_000_000
BUCKET_HASHES = 2_000_000
BIN_BYTES = 8_000_000
BIN_CELLS = 200_000
CELL_PAIRS = 64  # cells of more sets put all of them into one cluster
GROUPS = 64  # coordinates of the points in the R-tree
BOX = 16  # points in a box


@dataclass(frozen=True)
class Likeness:
    """``shingle`` words, and a link at ``100 * intersection >= percent * union``."""

    shingle: int = SHINGLE
    percent: int = PERCENT

    def __post_init__(self):
        if self.shingle < 1 or not 70 <= self.percent <= 100:
            raise ValueError("shingles have a word at least, and the likeness is from 70 to 100 percent")

    def bands(self, largest: int) -> np.ndarray:
        """Smallest sizes of the bands, up to one beyond ``largest``."""
        edges = [1]
        while edges[-1] <= 2 * largest:
            edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
        return np.array(edges)

    def differing(self, size: int) -> int:
        """The most shingles in which two linked sets of at most ``size`` each can differ."""
        return (100 - self.percent) * 2 * size // (100 + self.percent)

    def links(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (a + b - common)


def shingle_sets(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = W.word_hashes([(t or "").encode() for t in texts], fold_case=True)
    runs = W.run_hashes(words, shingle)
    out = []
    for start, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if end - start >= shingle:
            out.append(np.unique(runs[start : end - shingle + 1]))
        elif end > start:
            out.append(W.run_hashes(words[start:end], end - start) ^ np.uint64(end - start))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_node(hashes: np.ndarray) -> int | None:
    """A 64-bit name of a set; None for the empty one."""
    if not len(hashes):
        return None
    total = np.add.reduce(W.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))) + np.uint64(len(hashes))
    return int(W.mix(np.array([total]))[0].view(np.int64))


def blocks_for(most: int) -> int:
    """Blocks of a band whose linked sets differ in ``most`` shingles at most.

    The more blocks, the larger the part of its cells that a set shares with those it links with, and the more cells. A
    small set needs more: else so many of its blocks may be empty that it shares one cell only, or none but empty ones.
    """
    return most + 1 + max(most // 4, min(3 * most, 60))


def cells(hashes: np.ndarray, like: Likeness, bands: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each band in which a set can meet the sets it links with: hashes of its cells, and how many of them it shares
    with each of these sets at least."""
    n = len(hashes)
    home = int(np.searchsorted(bands, n, side="right")) - 1
    out = []
    for band in (home, home + 1):
        if band > home and 100 * n < like.percent * int(bands[band]):
            break  # larger sets of the next band are too large for this one
        most = like.differing(int(bands[band + 1]) - 1)
        blocks = blocks_for(most)
        block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        # A block's counts as one number: the sum of a hash of each shingle's group.
        group = W.mix((hashes & np.uint64(0xFFFFFFFF)) + np.uint64(1))
        order = np.argsort(block, kind="stable")
        present, start = np.unique(block[order], return_index=True)
        sums = np.add.reduceat(group[order], start)
        # Linked sets agree in all blocks but ``most``; where these may all be empty ones, empty blocks count too.
        shared = blocks - most - (blocks - len(present))
        if shared < 1:
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), present)
            present, sums = np.concatenate([present, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        out.append((W.mix(sums * np.uint64(3) + W.mix(present + np.uint64(band << 32))), max(1, shared)))
    return out


def points(sets: list[np.ndarray]) -> np.ndarray:
    """Group counts of each set."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    group = (np.concatenate(sets) >> np.uint64(20)) % np.uint64(GROUPS)
    return np.bincount(owner * GROUPS + group.astype(np.int64), minlength=len(sets) * GROUPS).reshape(len(sets), GROUPS)


def _possible(bound: np.ndarray, a: np.ndarray, b: np.ndarray, like: Likeness) -> np.ndarray:
    """May sets of sizes ``a`` and ``b`` with at most ``bound`` common shingles link?"""
    bound = np.minimum(bound, np.minimum(a, b))
    return like.links(bound, a, b)


def surviving(counts: np.ndarray, size: np.ndarray, like: Likeness) -> list[np.ndarray]:
    """For each point, later points that the R-tree can't rule out, by their rows."""
    m = len(size)
    order = np.lexsort((*counts[:, :2].T, size))  # sorted by size, then tiled by the first coordinates
    boxes = [order[i : i + BOX] for i in range(0, m, BOX)]
    upper = np.array([counts[b].max(0) for b in boxes])
    small, large = np.array([size[b].min() for b in boxes]), np.array([size[b].max() for b in boxes])
    out: list[list[np.ndarray]] = [[] for _ in range(m)]
    for i, rows in enumerate(boxes):
        # Boxes: the sum of minima of upper corners, against the smallest sizes that are near enough to each other.
        bound = np.minimum(upper[i], upper[i:]).sum(1)
        low = np.maximum(small[i:], (like.percent * small[i] + 99) // 100)
        near = (100 * large[i:] >= like.percent * small[i]) & (100 * large[i] >= like.percent * small[i:])
        for j in np.flatnonzero(near & (100 * bound >= like.percent * (small[i] + low - bound))) + i:
            others = boxes[j]
            minima = np.minimum(counts[rows][:, None], counts[others][None]).sum(2)
            ok = _possible(minima, size[rows][:, None], size[others][None], like)
            if i == j:
                ok = np.triu(ok, 1)
            for k in np.flatnonzero(ok.any(1)):
                out[rows[k]].append(others[ok[k]])
    return [np.concatenate(o) if o else np.empty(0, np.int64) for o in out]


def linked(sets: list[np.ndarray], like: Likeness, known: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """A label per set: the row of a set it is linked with, through others or itself.

    ``known`` are labels to start from. With ``side`` only pairs of a true and a false row are compared.
    """
    m = len(sets)
    label = np.arange(m) if known is None else np.unique(known, return_index=True, return_inverse=True)[1:]
    if known is not None:
        label = label[0][label[1]]
    size = np.array([len(s) for s in sets])
    candidates = surviving(points(sets), size, like)
    flat, start = np.concatenate(sets), np.cumsum([0, *size[:-1]])
    _, term = np.unique(flat, return_inverse=True)
    mark = np.zeros(int(term.max()) + 1 if len(term) else 1, bool)
    pairs_of: list[list[int]] = [[] for _ in range(m)]
    for i, others in enumerate(candidates):
        for j in others.tolist():
            if side is None or side[i] != side[j]:
                pairs_of[i].append(j)
    for i, others in enumerate(pairs_of):
        todo = np.array([j for j in others if label[j] != label[i]], np.int64)
        if not len(todo):
            continue
        own = term[start[i] : start[i] + size[i]]
        mark[own] = True
        if len(todo) * 4 > m:
            common = np.add.reduceat(mark[term].astype(np.int64), start)[todo]
        else:
            common = np.array([int(mark[term[start[j] : start[j] + size[j]]].sum()) for j in todo.tolist()])
        mark[own] = False
        for j in todo[like.links(common, size[i], size[todo])].tolist():
            if label[j] != label[i]:
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return label


# --- passes over batches of documents -------------------------------------------------------------------------


class _Batch:
    """Distinct sets of a batch that this batch stands for, and their cells."""

    def __init__(self, docs: pa.Table, kept: set[int], like: Likeness, bands: np.ndarray):
        sets = shingle_sets(docs["text"].to_pylist(), like.shingle)
        chosen: dict[int, np.ndarray] = {}
        for hashes in sets:
            node = set_node(hashes)
            if node in kept:
                chosen.setdefault(node, hashes)
        self.nodes = sorted(chosen)
        self.sets = [chosen[n] for n in self.nodes]
        self.cells = [cells(s, like, bands) for s in self.sets]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.cells:
            return np.empty(0, np.uint64), np.empty(0, bool)
        values, count = np.unique(np.concatenate([c for own in self.cells for c, _ in own]), return_counts=True)
        return values, count > 1


def _cell_pass(like: Likeness, bands: np.ndarray, n_buckets: int):
    def run(docs: pa.Table, stands: pa.Table) -> pa.Table:
        if not (docs.num_rows and stands.num_rows):
            return R.SENT_ARROW.empty_table()
        kept = stands["node"].to_pylist()
        number = docs["batch"][0].as_py()
        extra = [(-1 - number, np.array(kept, np.int64).tobytes())]
        return R.send(number, *_Batch(docs, set(kept), like, bands).found(), n_buckets, extra)

    return run


def _rarities(table: pa.Table) -> pa.Table:
    """Of each hash a batch sent: a bit that tells if it occurs again, and of those that do a byte each, larger for more frequent
    ones. All batches get the same byte for a hash."""
    if table["bucket"][0].as_py() < 0:
        return R.pass_on(table)
    batches, sizes, hashes = R.received(table)
    many = np.concatenate([R.unpack_bits(m, n) for m, n in zip(table["many"].to_pylist(), sizes, strict=True)])
    _, place = np.unique(hashes, return_inverse=True)
    count = np.bincount(place, 1 + many)[place]
    rarity = np.ceil(np.log2(count)).astype(np.uint8)
    cut = np.cumsum([0, *sizes])
    said = [R.pack_bits(own > 0) + own[own > 0].tobytes() for own in (rarity[s:e] for s, e in zip(cut, cut[1:], strict=False))]
    bucket = [table["bucket"][0].as_py()] * len(batches)
    return pa.Table.from_arrays([pa.array(batches, pa.int64()), pa.array(bucket, pa.int64()), pa.array(said, pa.binary())], schema=R.SAID_ARROW)


def _rarity_of(found: np.ndarray, answers: list[tuple[int, bytes]], n_buckets: int) -> np.ndarray:
    """``_rarities`` of a batch's sorted distinct hashes, in their order; 0 for those that occur nowhere else."""
    rarity, cut = np.zeros(len(found), np.uint8), R.cuts(found, n_buckets)
    for bucket, said in answers:
        n = int(cut[bucket + 1] - cut[bucket])
        again = R.unpack_bits(said[: (n + 7) // 8], n)
        rarity[cut[bucket] : cut[bucket + 1]][again] = np.frombuffer(said[(n + 7) // 8 :], np.uint8)
    return rarity


_CANDIDATE = "node long, size int, cells array<long>, shingles binary"
_CANDIDATE_ARROW = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("cells", pa.list_(pa.int64())), ("shingles", pa.binary())])


def _candidate_pass(like: Likeness, bands: np.ndarray, n_buckets: int):
    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        if not (docs.num_rows and said.num_rows):
            return _CANDIDATE_ARROW.empty_table()
        answers = dict(zip(said["bucket"].to_pylist(), said["bits"].to_pylist(), strict=True))
        kept = np.frombuffer(answers.pop(-1 - docs["batch"][0].as_py()), np.int64)
        batch = _Batch(docs, set(kept.tolist()), like, bands)
        found, _ = batch.found()
        rarity = _rarity_of(found, list(answers.items()), n_buckets)
        rows = []
        for node, hashes, own in zip(batch.nodes, batch.sets, batch.cells, strict=True):
            kept_cells = []
            for of_band, least in own:
                rare = rarity[np.searchsorted(found, of_band)]
                shared, rare = of_band[rare > 0], rare[rare > 0]
                if len(shared) >= least:  # else there is no set in this band that it could link with
                    # Two sets that share so many cells share one of their first ones in any order, but for the last
                    # least - 1; the rarest come first.
                    kept_cells.append(shared[np.lexsort((shared, rare))][: len(shared) - least + 1])
            if kept_cells:
                rows.append((node, len(hashes), np.concatenate(kept_cells).view(np.int64), hashes.tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _CANDIDATE_ARROW, strict=True)], schema=_CANDIDATE_ARROW)

    return run


_EDGE_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(a, b) -> pa.Table:
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE_ARROW)


def _cell_edges(like: Likeness):
    """What pairs of a bin's cells that the summed minima let through connect, as edges of clusters."""

    def run(table: pa.Table) -> pa.Table:
        cell, node = (np.asarray(table[c].combine_chunks()) for c in ("cell", "node"))
        size = np.asarray(table["size"].combine_chunks()).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, node, size = cell[order], node[order], size[order]
        point = np.frombuffer(b"".join(table["point"].to_pylist()), np.uint8).reshape(len(cell), -1)[order]
        start = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
        many = np.diff(np.r_[start, len(cell)])
        left, right = [], []
        for m in np.unique(many[many <= CELL_PAIRS]):
            i, j = np.triu_indices(m, 1)
            at = start[many == m][:, None]
            for part in range(0, len(at), max(1, 400_000 // max(1, len(i)))):
                rows = at[part : part + max(1, 400_000 // max(1, len(i)))]
                a, b = (rows + i).ravel(), (rows + j).ravel()
                if not len(a):
                    continue
                pair = np.unique(np.sort(np.stack([node[a], node[b]]), axis=0), axis=1, return_index=True)[1]
                a, b = a[pair], b[pair]
                bound = np.minimum(point[a], point[b]).sum(1, dtype=np.int64)
                # Counts beyond 255 are cut off there; what is cut off may be common too.
                bound += np.minimum(size[a] - point[a].sum(1, dtype=np.int64), size[b] - point[b].sum(1, dtype=np.int64))
                ok = _possible(bound, size[a], size[b], like)
                left.append(node[a[ok]])
                right.append(node[b[ok]])
        for s, m in zip(start[many > CELL_PAIRS], many[many > CELL_PAIRS], strict=True):
            left.append(np.full(m - 1, node[s : s + m].min()))
            right.append(np.delete(node[s : s + m], node[s : s + m].argmin()))
        if not left:
            return _EDGE_ARROW.empty_table()
        return _edges(*_stars(np.concatenate(left), np.concatenate(right)))

    return run


def _stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges that connect the same nodes: from each component's smallest node to its others."""
    nodes, ends = np.unique(np.stack([left, right]), return_inverse=True)
    ends = np.unique(np.sort(ends.reshape(2, -1), axis=0), axis=1)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in zip(*ends.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    smallest = np.array([find(i) for i in range(len(nodes))])
    away = smallest != np.arange(len(nodes))
    return nodes[smallest[away]], nodes[away]


def _search(like: Likeness):
    """Links in each cluster part of a bin: an edge from every set to one it is linked with."""

    def run(table: pa.Table) -> pa.Table:
        part = np.asarray(table["part"].combine_chunks())
        node, blobs = np.asarray(table["node"].combine_chunks()), table["shingles"].to_pylist()
        a, b = [], []
        for rows in np.split(order := np.argsort(part, kind="stable"), np.flatnonzero(np.diff(part[order])) + 1):
            rows = rows[np.unique(node[rows], return_index=True)[1]]
            label = linked([np.frombuffer(blobs[i], np.uint64) for i in rows.tolist()], like)
            away = label != np.arange(len(rows))
            a.append(node[rows[label[away]]])
            b.append(node[rows[away]])
        return _edges(np.concatenate(a), np.concatenate(b))

    return run


def _search_across(like: Likeness):
    """Links between the sets left over in a cluster and one of its leaves."""

    def run(table: pa.Table) -> pa.Table:
        node, label = (np.asarray(table[c].combine_chunks()) for c in ("node", "label"))
        over = np.asarray(table["over"].combine_chunks().to_numpy(zero_copy_only=False)).astype(bool)
        blobs = table["shingles"].to_pylist()
        found = linked([np.frombuffer(x, np.uint64) for x in blobs], like, known=label, side=over)
        return _edges(node[found], node)

    return run


def clusters(docs: DataFrame, like: Likeness | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents as ``(doc_id, n_shingles, node)``, and ``(node, label)`` of the sets that link with another set.

    Equal sets have the same node; sets with the same label are reachable by links.
    """
    like = like or Likeness()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def name(ids, texts):
        sets = shingle_sets(texts, like.shingle)
        return {"doc_id": ids, "n_shingles": [len(s) for s in sets], "node": [set_node(s) for s in sets], "chars": [len(t or "") for t in texts]}

    named = written(map_texts(docs, "doc_id long, n_shingles long, node long, chars long", name), "sets")
    size = named.agg(F.count("*").alias("rows"), F.sum("chars").alias("chars"), F.max("n_shingles").alias("largest")).first()
    if not size["largest"]:
        return named, spark.createDataFrame([], "node long, label long")
    bands, wide = like.bands(size["largest"]), parallelism(spark)
    n_batches = max(1, size["chars"] // BATCH_CHARS + 1, min(2 * wide, size["rows"]))
    # 2 * 1.25 cells for each shingle that may differ, with words of 5 characters; small sets have up to twice as many.
    n_buckets = max(1, min(wide, size["rows"]), size["chars"] // 5 * 5 * (100 - like.percent) // (100 + like.percent) // BUCKET_HASHES + 1)

    # Each set is followed up in one batch only: that of the smallest id among the documents that have it.
    batch_of = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(n_batches)).alias("batch")
    stands = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select(batch_of, "node")
    by_batch = docs.select(batch_of, "doc_id", "text").groupBy("batch")
    sent = by_batch.cogroup(stands.groupBy("batch")).applyInArrow(_cell_pass(like, bands, n_buckets), R.SENT)
    said = sent.groupBy("bucket").applyInArrow(_rarities, R.SAID)
    found = by_batch.cogroup(said.groupBy("batch")).applyInArrow(_candidate_pass(like, bands, n_buckets), _CANDIDATE)
    candidates = written(found, "candidates")

    amount = candidates.agg(F.sum(F.size("cells")).alias("cells"), F.sum(F.length("shingles")).alias("bytes")).first()
    if not amount["cells"]:
        return named, spark.createDataFrame([], "node long, label long")
    points_of = _with_points(candidates)
    n_bins = amount["cells"] // BIN_CELLS + 1
    met = points_of.select(F.explode("cells").alias("cell"), "node", "size", "point")
    near = met.groupBy(F.pmod(F.xxhash64("cell"), F.lit(n_bins)).alias("bin")).applyInArrow(_cell_edges(like), "a long, b long")
    labels = components(near)

    # Clusters of up to LEAF sets are searched whole, larger ones by leaves.
    counted = labels.groupBy("label").agg(F.count("*").alias("members"))
    leaves = F.ceil(F.col("members") / LEAF).cast("int")
    placed = candidates.select("node", "shingles").join(labels, "node").join(counted, "label").withColumn("leaves", leaves)
    placed = written(placed.withColumn("leaf", F.expr("cast(pmod(xxhash64(node, 1), leaves) as int)")), "placed")
    n_bins = max(wide, amount["bytes"] // BIN_BYTES + 1)
    parts = F.expr("if(leaf = 0 and leaves > 1, sequence(1, leaves - 1), array(leaf))")
    dealt = placed.withColumn("part_leaf", F.explode(parts)).select(F.xxhash64("label", "part_leaf").alias("part"), "node", "shingles")
    links = written(dealt.groupBy(F.pmod("part", F.lit(n_bins)).alias("bin")).applyInArrow(_search(like), "a long, b long"), "links")
    if placed.where("leaves > 1").head(1):
        links = links.unionByName(_left_over(placed, links, like))
    return named, components(links)


def _with_points(candidates: DataFrame) -> DataFrame:
    """Adds ``point``: group counts of the set as bytes, cut off at 255."""

    def work(node, size, own, shingles):
        counts = np.minimum(points([np.frombuffer(s, np.uint64) for s in shingles]), 255).astype(np.uint8)
        return {"node": node, "size": size, "cells": own, "point": [c.tobytes() for c in counts]}

    return map_texts(candidates, "node long, size int, cells array<long>, point binary", work)


def _left_over(placed: DataFrame, links: DataFrame, like: Likeness) -> DataFrame:
    """Links of the sets that are not in the largest component of their cluster, against all of the cluster."""
    so_far = components(links).withColumnRenamed("label", "part")
    large = placed.where("leaves > 1").join(so_far, "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = large.groupBy("label", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("label").agg(F.max(F.struct("n", "part")).alias("main"))
    large = written(large.join(main, "label").withColumn("over", F.col("part") != F.col("main.part")).drop("main"), "large")
    per_label = large.where("over").groupBy("label").agg(F.count("*").alias("n_over"))
    large = large.join(per_label, "label").withColumn("blocks", F.ceil(F.col("n_over") / LEAF).cast("int"))
    row = ["label", F.col("part").alias("known"), "node", "shingles"]
    left = large.where("over").withColumn("block", F.expr("cast(pmod(xxhash64(node, 2), blocks) as int)"))
    left = left.select(*row, F.lit(True).alias("over"), "block", F.explode(F.expr("sequence(0, leaves - 1)")).alias("leaf"))
    right = large.select(*row, F.lit(False).alias("over"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "leaf")
    both = left.unionByName(right).withColumnRenamed("label", "cluster").withColumnRenamed("known", "label")
    return written(both.groupBy("cluster", "block", "leaf").applyInArrow(_search_across(like), "a long, b long"), "links")


def join(docs: DataFrame, like: Likeness | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the smallest doc_id that links reach, for every row of ``docs``."""
    named, labels = clusters(docs, like)
    first = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    by_node = first.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = by_node.groupBy("label").agg(F.min("first").alias("component_id"))
    component = by_node.select("node", "label").join(by_label, "label").select("node", "component_id")
    return named.join(component, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))



def keep_first(docs: DataFrame, like: Likeness | None = None) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest ``doc_id``. Documents linked with nothing stay, also
    those without words; rows without id stay unless they are linked with a document that has one. Of repeated rows
    (same id and text) one stays. All columns stay as they are.
    """
    if docs.where("doc_id is null").head(1):
        return _keep_first_unnamed(docs, like)
    found = join(docs, like)
    repeated = found.groupBy("doc_id").count().where("count > 1").head(1)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    out = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def _keep_first_unnamed(docs: DataFrame, like: Likeness | None) -> DataFrame:
    """``keep_first`` where rows without id occur: these are numbered behind all ids, and the table is written with the
    numbers. Ids and the number of rows must stay below 2**62."""
    name = "number"
    while name in map(str.lower, docs.columns):
        name += "_"
    number = F.col("doc_id").cast("long")
    last = docs.agg(F.max(number)).first()[0]
    last = -1 if last is None else last
    after = F.lit(last + 1).cast("long") + F.monotonically_increasing_id()
    numbered = written(docs.withColumn(name, F.coalesce(number, after)), "numbered")
    found = join(numbered.select(F.col(name).alias("doc_id"), "text"), like)
    kept = found.where((F.col("doc_id") == F.col("component_id")) | (F.least("doc_id", "component_id") > last))
    kept = kept.select(F.col("doc_id").alias(name)).distinct()
    one = numbered.join(kept, name, "left_semi").withColumn(name, F.when(F.col("doc_id").isNull(), F.col(name)))
    return one.dropDuplicates(["doc_id", "text", name]).select(*docs.columns)
