"""Best-fit packing: token sequences of whole documents into as few bins as they take.

Documents are tokenized (word BPE, then id 0), and only those longer than a
bin are cut. Pieces are dealt at random into blocks of bounded size, and each
block is packed by itself: best fit on falling lengths, then a local search
that empties bins. The search goes through the bins by rising fill and moves
tokens into bins that are at least as full, by giving one or two pieces for
none, one or two shorter ones; each step raises the sum of squared fills. The
roomiest bin for each length that may come back is kept at hand, so no bins
are scanned. It ends at the least possible number of bins, or when no bin has
such an exchange left.

Ids stay with their pieces; ``sequences`` gives what a model is trained on, the
ids of whole bins.

Defined results: a null text counts as empty; an empty text is id 0 alone.
Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from tidemark.llm.arrow import map_texts
from tidemark.llm.columns import carry
from tidemark.llm.components import written

CAPACITY = 2048
BLOCK_PIECES = 50_000
CACHED_WORDS = 250_000  # per worker

# The pre-tokenizer's pattern, and its byte-to-character table by rule: fixed by the vocabulary.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# What Python's split() takes for white space and the tokenizer may not.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in set(_SHOWN)]
_AS_CHARACTER = {**{b: chr(b) for b in _SHOWN}, **{b: chr(256 + i) for i, b in enumerate(_HIDDEN)}}


class WordIds(dict):
    """Ids of a white-space separated word as little-endian unsigned 32-bit bytes, remembered.

    The tokenizer never joins across white space, so a text's ids are those of its words in order. Words of Latin
    letters are normalised here and their parts looked up by themselves; others go through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if (word.isascii() or max(word) < "ɐ" and "İ" not in word) and "<|" not in word and not _ODD_SPACE.search(word):
            text = unicodedata.normalize("NFC", word).lower()
            found = self._part(text) if text.isascii() and text.isalpha() else b"".join(map(self._part, _PIECES.findall(text)))
        else:
            found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = found
        return found

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= self.limit:
                self.parts.clear()
            shown = part if part.isascii() else "".join(_AS_CHARACTER[b] for b in part.encode())
            found = self.parts[part] = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        return found

    def text(self, text: str) -> bytes:
        # Only white space that the tokenizer certainly takes as such separates words here.
        if _ODD_SPACE.search(text):
            return b"".join(self[w] for w in regex.split(r"[ \t\r\n]+", text) if w)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


_PIECE = "piece int, start long, length long, ids binary, salt int"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids`` and ``salt`` (any number) of each piece of each text.

    ``ids`` are little-endian unsigned 32-bit numbers.
    """
    last = array("I", [end]).tobytes()

    def work(ids, texts):
        encode = word_ids(tokenizer).text
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "salt")}
        for doc_id, text in zip(ids, texts, strict=True):
            data = encode(text or "") + last
            for n, at in enumerate(range(0, len(data), 4 * capacity)):
                cut = data[at : at + 4 * capacity]
                row = (doc_id, n, at // 4, len(cut) // 4, cut, len(out["salt"]))
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
        return out

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), f"doc_id long, {_PIECE}", work)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of items: each item, longest first, into the bin it leaves least room in."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: there is a bin with room r
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            at, room = len(bins), capacity
            bins.append([item])
        left = room - n
        by_room[left].append(at)
        rooms |= 1 << left
    return bins


def _parts(items: list[int], length: list[int]) -> dict[int, tuple[int, ...]]:
    """For each number of tokens that none, one or two of the items have together, such items; the fewest possible."""
    by: dict[int, list[int]] = {}
    for i in items:
        by.setdefault(length[i], []).append(i)
    parts, sizes = {}, sorted(by)
    for at, a in enumerate(sizes):
        for b in sizes[at:]:
            if a != b or len(by[a]) > 1:
                parts[a + b] = (by[a][0], by[b][-1])
    return parts | {a: (by[a][0],) for a in sizes} | {0: ()}


class _Rooms:
    """The roomiest bin among those that could give back ``v`` tokens, for each ``v``."""

    def __init__(self, capacity: int):
        self.most = np.full(capacity + 1, -1)
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.held: dict[int, tuple[int, int]] = {}  # room and turn of a bin that is in
        self.turn, self.sizes = 0, np.arange(capacity + 1)
        self.reach: np.ndarray | None = None

    def add(self, k: int, room: int, parts: dict[int, tuple[int, ...]]) -> None:
        self.turn += 1
        self.held[k] = (room, self.turn)
        for v in parts:
            heappush(self.heaps[v], (-room, k, self.turn))
            if room > self.most[v]:
                self.most[v], self.reach = room, None

    def drop(self, k: int, parts: dict[int, tuple[int, ...]]) -> None:
        room = self.held.pop(k)[0]
        for v in parts:
            if room == self.most[v]:
                heap = self.heaps[v]
                while heap and self.held.get(heap[0][1], (0, 0))[1] != heap[0][2]:
                    heappop(heap)
                if (now := -heap[0][0] if heap else -1) != room:
                    self.most[v], self.reach = now, None

    def best(self, sizes: np.ndarray) -> tuple[int, int, int]:
        """The exchange that moves most tokens, by tokens given out of ``sizes``, tokens back and bin (-1 for none)."""
        if self.reach is None:  # the least v such that a bin takes n for it
            self.reach = np.searchsorted(np.maximum.accumulate(np.where(self.most < 0, 0, self.sizes + self.most)), self.sizes)
        possible = sizes[sizes < len(self.reach)]
        gain = possible - self.reach[possible]
        at = int(gain.argmax()) if len(gain) else -1
        if at < 0 or gain[at] <= 0:
            return 0, 0, -1
        back = int(self.reach[possible[at]])
        return int(possible[at]), back, self.heaps[back][0][1]


def least_bins(length: list[int], capacity: int) -> int:
    """No packing has fewer bins: by all tokens, and by pieces of which no two share a bin."""
    return max(-(-sum(length) // capacity), sum(2 * n > capacity for n in length))


def local_search(bins: list[list[int]], length: list[int], capacity: int) -> list[list[int]]:
    """Empty bins by exchanges with bins at least as full, until the fewest possible are left or no exchange is.

    Of equally full bins either gives in turn, by the order of the sweep; the search ends after two sweeps in vain.
    """
    least, alive, quiet, order = least_bins(length, capacity), len(bins), 0, 1
    if alive <= least:
        return bins
    fill = [sum(length[i] for i in b) for b in bins]
    parts = [_parts(b, length) for b in bins]
    while alive > least and quiet < 2:
        rooms, order, quiet = _Rooms(capacity), -order, quiet + 1
        for k, f in enumerate(fill):
            if 0 < f < capacity:
                rooms.add(k, capacity - f, parts[k])
        donors = [(fill[k], order * k) for k in rooms.held]
        heapify(donors)
        while donors:
            f, donor = heappop(donors)
            donor *= order
            if donor not in rooms.held or f != fill[donor]:  # it has taken tokens meanwhile
                continue
            rooms.drop(donor, parts[donor])
            while fill[donor]:
                given, got, taker = rooms.best(np.array([n for n in parts[donor] if n]))
                if taker < 0:
                    break
                out, back = parts[donor][given], parts[taker][got]
                rooms.drop(taker, parts[taker])
                for k, gone, new, tokens in ((donor, out, back, got - given), (taker, back, out, given - got)):
                    bins[k] = [i for i in bins[k] if i not in gone] + list(new)
                    fill[k] += tokens
                    parts[k] = _parts(bins[k], length)
                if fill[taker] < capacity:
                    rooms.add(taker, capacity - fill[taker], parts[taker])
                    heappush(donors, (fill[taker], order * taker))
                quiet = 0
            if not fill[donor]:
                alive -= 1
                if alive <= least:
                    break
    return [b for b in bins if b]


def pack_block(length: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item."""
    which, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    for n, items in enumerate(local_search(best_fit(length, capacity), length, capacity)):
        at = 0
        for i in sorted(items):
            which[i], offset[i] = n, at
            at += length[i]
    return which, offset


def pack(items: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` (1 to ``capacity``) and a ``salt``; any other columns stay
    (clashes: see ``columns``).

    ``items`` should be a written table: blocks are dealt by its columns, and a lost task reads it again.
    """
    n_blocks = max(1, -(-items.count() // block_pieces))
    others = [c for c in items.columns if c not in ("length", "salt")]
    kept, inner, back = carry(others, ["length", "sequence_id", "offset"])
    inner_of = dict(zip(others, inner, strict=True)) | {"length": "length"}
    simple = [inner_of[c] for c in items.columns if c != "salt" and items.schema[c].dataType.typeName() in ("long", "integer", "string")]
    items = items.select(*kept, "length", "salt")
    block = F.pmod(F.xxhash64(*simple, "salt"), F.lit(n_blocks)).alias("block_of_pieces")
    inner = [*inner, "length"]
    types = items.select(*inner, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(table: pa.Table) -> pa.Table:
        number = table["block_of_pieces"][0].as_py()
        table = table.select(inner).sort_by([(c, "ascending") for c in simple])
        which, offset = pack_block(table["length"].to_pylist(), capacity)
        return table.append_column("sequence_id", pa.array(which + (number << 32))).append_column("offset", pa.array(offset))

    return back(items.select(*inner, block).groupBy("block_of_pieces").applyInArrow(run, types))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack: a row per piece, with its ``ids`` and their CRC.

    Pieces are numbered as they are written, packed by their lengths alone, and joined to their ids by that number.
    """
    made = written(pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    packed = pack(made.drop("ids"), capacity)
    return packed.join(made.select("row", "ids"), "row").drop("row").withColumn("ids_crc32", F.crc32("ids"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, the token ``ids`` of the whole sequence, and its ``pieces`` (without their ids) in order.

    ``packed`` has a row per piece, as ``pack_documents`` gives it.
    """
    of_piece = ["offset", "doc_id", "piece", "start", "length"]
    kinds = ", ".join(f"`{c}`: {packed.schema[c].dataType.simpleString()}" for c in of_piece)
    fields = to_arrow_schema(packed.sparkSession.createDataFrame([], f"sequence_id long, ids array<int>, pieces array<struct<{kinds}>>").schema)
    gathered = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct(*of_piece, "ids"))).alias("parts"))
    gathered = gathered.select("sequence_id", "parts.ids", F.transform("parts", lambda p: F.struct(*[p[c].alias(c) for c in of_piece])).alias("pieces"))

    def join(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [np.frombuffer(b"".join(cuts), "<i4") for cuts in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["sequence_id"], pa.array(ids, fields.field("ids").type), part["pieces"].cast(fields.field("pieces").type)], schema=fields)

    return gathered.mapInArrow(join, f"sequence_id long, ids array<int>, pieces array<struct<{kinds}>>")
