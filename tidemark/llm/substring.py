"""Substring dedup: cut every word that lies in a long passage which starts earlier in the corpus.

A window is ``window`` successive words of one document. Of equal windows the
first in the order of (doc_id, start) stays; every word covered by another one
is cut. Windows are judged on the input.

Method: a De Bruijn graph of word k-mers, whose edges are the windows and whose
nodes are what two successive windows share. To begin with, of the short k-mers
of a window only its minimizer (the one with the smallest hash) is looked at, so
a seventh of them tells which windows can be repeated at all: a repeated window
has a repeated minimizer. The edges of the graph are these windows. An edge has
one way in if all its occurrences follow the same word, and one way out if the
same word follows all. Where one way out meets one way in, the node between does
not branch; edges joined by such nodes compact to a path. All occurrences of a
path's first edge go through the whole path, so the path's source, the smallest
(doc_id, start) of its first edge, is the source of all its edges. Occurrences
meet the words at their path's source in a join, and are compared with them
word by word; windows that only have equal hashes stay.

Spark's part: documents are dealt to batches of a few megabytes by hash, and
that one shuffle is reused by all passes. A batch sends each hash to its
bucket once, however often it holds it, so that a hot passage costs a row per
batch. A bucket answers with one bit per hash, and sends each repeated edge once
to its source's batch, where paths are runs along the source. A path's words are
sent once and joined to the batches that hold the path; of a hot path Spark
splits the many. Batches and buckets have a size that does not grow with the
data; their number does.

Defined results: a null text has no words. A null doc_id comes after all
others. Rows with the same doc_id and different texts are told apart by their
text; repeated rows (same doc_id and text) count as one document and get the
same result each. An empty table gives an empty result. Very long texts are one
batch each. Clashing names of kept columns: see ``columns``. Hashes have 64
bits; a window goes if its hash starts earlier and its words are those at the
source of its path. Where different neighbouring words have equal 16-bit hashes, a
branch is taken for none; windows that come after it without the path's first
edge go by their own hashes alone.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm import repeats as R
from tidemark.llm import words as W
from tidemark.llm.columns import carry, types_of
from tidemark.session import parallelism

WINDOW = 20
EDGE = 8
BATCH_CHARS = 1_000_000
BUCKET_HASHES = 2_000_000
LAST = np.iinfo(np.int64).max

# What a batch sends to a bucket: per distinct window its hash, its first place with that document's id, and the
# words before and after it; and the packed flags of ``_FLAGS`` one after the other.
_SENT = "batch long, bucket long, hashes binary, ids binary, places binary, before binary, after binary, flags binary"
_FLAGS = ("one_in", "one_out", "many")
_EDGES = "edge long, batch long, place_and_ways long, bucket long"
_PASSAGES = "path long, n long, words binary"
# What a bucket answers: with ``at`` null, a bit per hash sent; else, that the hash number ``at`` begins a path.
_TOLD = "batch long, bucket long, bits binary, path long, at long"


class _Batch:
    """Words, windows and minimizers of a batch's distinct documents in order."""

    def __init__(self, table: pa.Table, window: int, edge: int):
        ids = [LAST if i is None else i for i in table["doc_id"].to_pylist()]
        texts = [(t or "").encode() for t in table["text"].to_pylist()]
        self.documents = sorted(set(zip(ids, texts, strict=True)))
        self.row_of = {key: i for i, key in enumerate(self.documents)}
        self.keys = list(zip(ids, texts, strict=True))
        self.ids = np.array([i for i, _ in self.documents], np.int64)
        self.words, self.first = W.word_hashes([t for _, t in self.documents])
        self.inside = W.inside_texts(self.first, window)
        self.window, self.edge = window, edge
        self.smallest = np.empty(0, np.uint64)
        if len(self.inside):
            self.edges = W.run_hashes(self.words, edge)
            self.smallest = W.sliding(self.edges, window - edge + 1)

    @cached_property
    def _plain(self) -> tuple[bytes, np.ndarray]:
        """All words joined by one space, and where each starts (with one past the end)."""
        joined, starts, ends, _ = W.word_spans([t for _, t in self.documents])
        data, keep = np.frombuffer(joined, np.uint8).copy(), np.zeros(len(joined) + 1, np.int8)
        np.add.at(keep, starts, 1)
        np.add.at(keep, ends + 1, -1)  # the byte after a word is white: it becomes the space
        data[ends] = 32
        return data[np.cumsum(keep[:-1]) > 0].tobytes(), np.concatenate([[0], np.cumsum(ends - starts + 1)])

    def said(self, place: int, n: int) -> bytes:
        """``n`` words from ``place`` on, joined by one space."""
        text, at = self._plain
        return text[at[place] : at[min(place + n, len(at) - 1)] - 1]

    def neighbours(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """16-bit hashes of the words before and after the windows at these places, and whether there are any."""
        doc = np.searchsorted(self.first, at, side="right") - 1
        has_before, has_after = at > self.first[doc], at + self.window < self.first[doc + 1]
        padded = (np.concatenate([self.words, np.zeros(1, np.uint64)]) >> np.uint64(48)).astype(np.uint16)
        return padded[at - 1], padded[at + self.window], has_before, has_after

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimizers of the batch's windows, and which of them occur more than once in it."""
        if not self.inside.any():
            return np.empty(0, np.uint64), np.empty(0, bool)
        span = self.window - self.edge + 1
        # An edge is a minimizer if it equals the largest of the minima of the windows it is in.
        minima = np.where(self.inside, self.smallest, np.uint64(0))
        padded = np.concatenate([np.zeros(span - 1, np.uint64), minima, np.zeros(span - 1, np.uint64)])
        covering = W.sliding(padded, span, np.maximum)
        found, count = np.unique(self.edges[(covering == self.edges) & (covering > 0)], return_counts=True)
        return found, count > 1

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows in ``repeated`` (a mask of window places)."""
        at = np.flatnonzero(repeated)
        return at, W.run_hashes(self.words, self.window)[at] if len(at) else np.empty(0, np.uint64)


def _anchor_pass(n_buckets: int, window: int, edge: int):
    def run(table: pa.Table) -> pa.Table:
        return R.send(table["batch"][0].as_py(), *_Batch(table, window, edge).anchors(), n_buckets)

    return run


def _anchored(batch: _Batch, said: pa.Table, n_buckets: int) -> np.ndarray:
    """Mask of the batch's windows whose minimizer repeats."""
    found, _ = batch.anchors()
    answers = list(zip(said["bucket"].to_pylist(), said["bits"].to_pylist(), strict=True))
    flags = R.flags_of(found, answers, n_buckets)
    mask = np.zeros(len(batch.inside), bool)
    at = np.flatnonzero(batch.inside)
    if len(at):
        mask[at] = flags[np.searchsorted(found, batch.smallest[at])]
    return mask


def _sources(batch: _Batch, mask: np.ndarray, n_buckets: int):
    """First places of the batch's distinct masked windows, ordered by bucket and then as they come, with the cuts between buckets; all masked windows' places; and each one's distinct window."""
    at, hashes = batch.windows(mask)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    bucket = np.searchsorted(R.bucket_edges(n_buckets), hashes[first], side="right")
    order = np.lexsort((first, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return hashes[first][order], first[order], np.searchsorted(bucket[order], np.arange(n_buckets + 1)), at, rank[which]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = _arrow(schema)
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def _always(same: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` groups: does ``same`` hold for all its members?"""
    return np.bincount(which[~same], minlength=n) == 0


def _edge_pass(n_buckets: int, window: int, edge: int):
    """The edges of a batch, sent to their buckets."""

    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(_SENT, [])
        number = docs["batch"][0].as_py()
        batch = _Batch(docs, window, edge)
        mask = _anchored(batch, said, n_buckets)
        hashes, first, cut, at, which = _sources(batch, mask, n_buckets)
        rows = []
        if len(at):
            places = at[first]
            ids = batch.ids[np.searchsorted(batch.first, places, side="right") - 1]
            before, after, has_before, has_after = batch.neighbours(at)
            flags = [_always(has & (word == word[first][which]), which, len(first)) for word, has in ((before, has_before), (after, has_after))]
            flags.append(np.bincount(which, minlength=len(first)) > 1)
            parts = (hashes, ids, places.astype(np.uint32), before[first], after[first])
            for b, (s, e) in enumerate(zip(cut, cut[1:], strict=False)):
                if e > s:
                    rows.append((number, b, *(x[s:e].tobytes() for x in parts), b"".join(R.pack_bits(f[s:e]) for f in flags)))
        # The mask itself travels along to the last pass, under a bucket of the batch's own.
        return _table(_SENT, [*rows, (number, -1 - number, *[b""] * 5, R.pack_bits(mask))])

    return run


class _Bucket:
    """The edges that the batches sent to a bucket; equal ones together, in order of their first places."""

    def __init__(self, table: pa.Table):
        self.batches, self.sizes, hashes = R.received(table)
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
        sender = np.repeat(np.array(self.batches, np.int64), self.sizes)
        self.order = np.lexsort((sender, read("ids", np.int64), hashes))
        self.hashes, self.sender, self.places = hashes[self.order], sender[self.order], read("places", np.uint32)[self.order]
        self.before, self.after = read("before", np.uint16)[self.order], read("after", np.uint16)[self.order]
        flags = [[], [], []]
        for bits, n in zip(table["flags"].to_pylist(), self.sizes, strict=True):
            size = (n + 7) // 8
            for i, out in enumerate(flags):
                out.append(R.unpack_bits(bits[i * size : (i + 1) * size], n))
        self.one_in, self.one_out, self.many = (np.concatenate(f)[self.order] for f in flags)
        self.starts = np.flatnonzero(np.diff(self.hashes, prepend=~self.hashes[:1]))
        self.sizes_of_groups = np.diff(np.append(self.starts, len(self.hashes)))


def _repeated_edges(table: pa.Table) -> pa.Table:
    """Each edge that occurs more than once, with its source: four times its place, and 2 for one way in, 1 for one way out."""
    number = table["bucket"][0].as_py()
    if number < 0:
        return _table(_EDGES, [])
    bucket = _Bucket(table)
    start, group = bucket.starts, np.repeat(np.arange(len(bucket.starts)), bucket.sizes_of_groups)
    one_in = _always(bucket.one_in & (bucket.before == bucket.before[start][group]), group, len(start))
    one_out = _always(bucket.one_out & (bucket.after == bucket.after[start][group]), group, len(start))
    repeated = (bucket.sizes_of_groups > 1) | bucket.many[start]
    at = start[repeated]
    columns = [bucket.hashes[at].view(np.int64), bucket.sender[at], bucket.places[at].astype(np.int64) * 4 + one_in[repeated] * 2 + one_out[repeated], np.full(len(at), number)]
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_arrow(_EDGES))


def paths_of(edges: DataFrame) -> DataFrame:
    """Nonbranching paths ``(path, bucket, batch, place, n)``: the first edge, its source, and the number of edges.

    An edge goes on the path of the one before it at its source if that has one way out and it has one way in: both
    then have the same occurrences, so their sources lie side by side.
    """
    along = Window.partitionBy("batch").orderBy("place_and_ways")
    place = lambda column: F.shiftright(column, 2)
    has = lambda way, column: column.bitwiseAND(F.lit(way)) != 0
    here, last = F.col("place_and_ways"), F.lag("place_and_ways").over(along)
    goes_on = has(2, here) & has(1, last) & (place(last) == place(here) - 1)
    marked = edges.select("edge", "batch", "bucket", place(here).alias("place"), (~F.coalesce(goes_on, F.lit(False))).alias("starts"), here)
    head = F.last(F.when(F.col("starts"), F.col("place")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    first = lambda name: F.max(F.when(F.col("starts"), F.col(name))).alias(name)
    paths = marked.withColumn("head", head).groupBy("batch", "head").agg(first("edge"), first("bucket"), F.count("*").alias("n"))
    return paths.select(F.col("edge").alias("path"), "bucket", "batch", F.col("head").alias("place"), "n")


def _passages(window: int, edge: int):
    """The words of the paths whose source is in a batch."""

    def run(docs: pa.Table, paths: pa.Table) -> pa.Table:
        if not paths.num_rows:
            return _table(_PASSAGES, [])
        batch = _Batch(docs, window, edge)
        spans = zip(*(paths[c].to_pylist() for c in ("path", "n", "place")), strict=True)
        return _table(_PASSAGES, [(path, n, batch.said(place, n + window - 1)) for path, n, place in spans])

    return run


def _tell(sent: pa.Table, paths: pa.Table) -> pa.Table:
    """To each batch: which of its edges start earlier in another batch, and which begin a path that it may have to cut."""
    if not sent.num_rows:
        return _table(_TOLD, [])
    number = sent["bucket"][0].as_py()
    # Rows of bits have a key of their own, so that the join with passages deals them evenly.
    key = lambda batch: int(W.mix(np.array([batch * 2_000_003 + number], np.int64).view(np.uint64)).view(np.int64)[0])
    if number < 0:
        return _table(_TOLD, [(b, number, f, key(b), None) for b, f in zip(sent["batch"].to_pylist(), sent["flags"].to_pylist(), strict=True)])
    bucket = _Bucket(sent)
    earlier = np.ones(len(bucket.hashes), bool)
    earlier[bucket.starts] = False
    begins = np.isin(bucket.hashes, paths["path"].to_numpy().view(np.uint64)) & (earlier | bucket.many)
    later = np.empty(len(earlier), bool)
    later[bucket.order] = earlier
    cut = np.cumsum([0, *bucket.sizes])
    rows = [(b, number, R.pack_bits(later[s:e]), key(b), None) for b, s, e in zip(bucket.batches, cut, cut[1:], strict=False)]
    place = bucket.order[begins]
    own = np.searchsorted(cut, place, side="right") - 1
    heads = zip(bucket.sender[begins].tolist(), bucket.hashes[begins].view(np.int64).tolist(), (place - cut[own]).tolist(), strict=True)
    return _table(_TOLD, [*rows, *((b, number, None, path, at) for b, path, at in heads)])


def _differs(batch: _Batch, place: int, n: int, words: bytes, window: int) -> list[int]:
    """Of the ``n`` windows from ``place`` on, those with the hash but not the words of the path's; none where all words are equal."""
    if batch.said(place, n + window - 1) == words:
        return []
    hashes, _ = W.word_hashes([words])
    own, theirs = W.run_hashes(batch.words, window), W.run_hashes(hashes, window)
    here, there = batch.said(place, n + window - 1).split(b" "), words.split(b" ")
    return [place + i for i in range(min(n, len(own) - place)) if own[place + i] == theirs[i] and here[i : i + window] != there[i : i + window]]


def _cut_pass(n_buckets: int, window: int, edge: int, schema: pa.Schema, texts_wanted: bool):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        batch = _Batch(docs, window, edge)
        rows = told.select(["bucket", "bits", "at", "n", "words"]).to_pylist()
        answers = {r["bucket"]: r["bits"] for r in rows if r["at"] is None}
        number = docs["batch"][0].as_py()
        mask = R.unpack_bits(answers.pop(-1 - number), len(batch.inside)) if len(batch.inside) else np.empty(0, bool)
        _, first, cut, at, which = _sources(batch, mask, n_buckets)
        earlier = np.zeros(len(first), bool)
        for bucket, bits in answers.items():
            if bucket >= 0:
                earlier[cut[bucket] : cut[bucket + 1]] = R.unpack_bits(bits, cut[bucket + 1] - cut[bucket])
        # A window goes if it starts earlier in another batch, or is not the first of its kind in this one.
        goes = np.zeros(len(batch.words) + 1, bool)
        if len(at):
            goes[at[earlier[which] | (first[which] != np.arange(len(at)))]] = True
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(first) + 1))
        for r in rows:
            if r["at"] is not None:
                head = cut[r["bucket"]] + r["at"]
                for place in at[order[bounds[head] : bounds[head + 1]]].tolist():
                    goes[_differs(batch, place, r["n"], r["words"], window)] = False
        covered, gone = np.zeros(len(batch.words) + window + 1, np.int64), np.flatnonzero(goes)
        np.add.at(covered, gone, 1)
        np.add.at(covered, gone + window, -1)
        return _kept(docs, batch, np.cumsum(covered)[: len(batch.words)] > 0, schema, texts_wanted)

    return run


def _kept(docs: pa.Table, batch: _Batch, removed: np.ndarray, schema: pa.Schema, texts_wanted: bool) -> pa.Table:
    out = []
    for i, (_, data) in enumerate(batch.documents):
        gone = removed[batch.first[i] : batch.first[i + 1]]
        n = int(gone.sum())
        text = data
        if n or not texts_wanted:
            text = b" ".join(data.split() if not n else [w for w, g in zip(data.split(), gone.tolist(), strict=True) if not g])
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False])).tolist() if n else []
        out.append((len(gone), n, hashlib.sha256(text).hexdigest(), text.decode(), list(zip(edges[::2], edges[1::2], strict=True))))
    rows = [out[batch.row_of[k]] for k in batch.keys]
    columns = {
        "n_words": [r[0] for r in rows],
        "n_removed": [r[1] for r in rows],
        "kept_sha256": [r[2] for r in rows],
        "kept_text": [r[3] for r in rows] if texts_wanted else None,
        "spans": [[{"start": s, "end": e} for s, e in r[4]] for r in rows],
    }
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else docs[f.name].combine_chunks().cast(f.type) for f in schema]
    return pa.Table.from_arrays(arrays, schema=schema)


def dedup(docs: DataFrame, keep: list[str] = (), window: int = WINDOW, edge: int = EDGE, texts: bool = False) -> DataFrame:
    """``doc_id``, the ``keep`` columns (clashes: see ``columns``), ``n_words``, ``n_removed``, ``kept_sha256``, ``spans`` (word numbers cut, ends
    exclusive) of every row; with ``texts``, ``kept_text`` too: the kept words joined by one space, or the text as it
    was where nothing is cut (``kept_sha256`` is then of that text).
    """
    if not 1 <= edge <= window:
        raise ValueError("an edge is at most as long as a window")
    spark = docs.sparkSession
    own = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts + ["spans"]
    kept, inner, back = carry([c for c in keep if c != "doc_id"], ["doc_id", *own])
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    chars = size["chars"] or 0
    wide = parallelism(spark)
    n_batches = max(1, chars // BATCH_CHARS + 1, min(2 * wide, size["rows"]))
    # Words are taken to have 5 characters; about 2 of 14 k-mers are minimizers, and at most all windows repeat.
    n_buckets = max(1, min(wide, size["rows"]), chars // 5 // 3 // BUCKET_HASHES + 1)
    dealt = docs.select(
        F.pmod(F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))), F.lit(n_batches)).alias("batch"),
        F.col("doc_id").cast("long").alias("doc_id"),
        *kept,
        F.col("text").cast("string").alias("text"),
    )
    types = ", ".join(["doc_id long"] + [types_of(dealt.select(*inner))] * bool(inner) + ["n_words long, n_removed long, kept_sha256 string"] + ["kept_text string"] * texts + ["spans array<struct<start: int, end: int>>"])
    schema = to_arrow_schema(spark.createDataFrame([], types).schema)
    by_batch = dealt.groupBy("batch")
    sent = by_batch.applyInArrow(_anchor_pass(n_buckets, window, edge), R.SENT)
    said = sent.groupBy("bucket").applyInArrow(R.repeated, R.SAID)
    sent = by_batch.cogroup(said.groupBy("batch")).applyInArrow(_edge_pass(n_buckets, window, edge), _SENT)
    by_bucket = sent.groupBy("bucket")
    paths = paths_of(by_bucket.applyInArrow(_repeated_edges, _EDGES))
    passages = by_batch.cogroup(paths.groupBy("batch")).applyInArrow(_passages(window, edge), _PASSAGES)
    told = by_bucket.cogroup(paths.select("bucket", "path").groupBy("bucket")).applyInArrow(_tell, _TOLD)
    met = told.join(passages, "path", "left").select("batch", "bucket", "bits", "at", "n", "words")
    cut = by_batch.cogroup(met.groupBy("batch")).applyInArrow(_cut_pass(n_buckets, window, edge, schema, texts), types)
    return back(cut)
