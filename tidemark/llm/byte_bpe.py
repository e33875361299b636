"""Byte-level BPE encoding and decoding with DataFrame expressions.

A text is cut into words by the vocabulary's pattern. A word begins as its bytes, each as the id of its piece.
Adjacent pieces whose joined bytes have the lowest rank are merged, the leftmost first, until no joined bytes have a
rank; what is left are the ids, as a piece's id is its rank. ``fold`` does this by higher-order functions. The ranks
are literals: hash maps from pairs of ids to the rank of their joined bytes (``Merges``, and ``Ranks`` for long words,
two arrays of which each pair is in one at the place that its number gives).

Ids are held as text, a character each, in the order of the ids (``character``). A short word is two such texts: its
ids, and the ranks of its pairs. So a merge is a handful of functions of strings, whatever the word's length, and only
the two pairs that a merge makes are looked up.

Distinct words: the ``TABLE_WORDS`` most frequent distinct words of about ``SAMPLE_ROWS`` documents are folded once,
in Spark, and become a second literal, in which most words of a corpus are found. A word that is not there is folded
where it stands, so the sample decides how fast the encoding is, never what it gives. There is no shuffle but the
count of the sampled words; texts stay where they are.

Words of up to ``SHORT`` bytes merge one pair at a time. In words of more than ``SHORT`` bytes all pairs of the lowest rank merge in
one step, from left to right, unless a merge among them would make a pair of a lower rank still: then only the
leftmost does. So a run of a million equal characters takes some twenty steps over it.

Decoding looks up each id's bytes in a literal array and joins them. Bytes are held as text of the characters U+0000
to U+00FF meanwhile.

Defined results: null and empty texts have no ids. Repeated rows are rows like any other; nothing depends on other
rows, so there are no ties. An empty table gives an empty table. Texts may be of any length. Kept columns may be
called anything (see ``columns``). Letters and numbers of the pattern are those of the JVM's Unicode tables. Decoding
null ids gives null; numbers that are no ids, and nulls among the ids, give no bytes.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import carry

# Fixed value: white space as Unicode defines it; the pattern's \s and \S, as Java's own are ASCII only.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

SHORT = 64
SAMPLE_ROWS = 8_000
TABLE_WORDS = 50_000


@dataclass(frozen=True)
class Literal:
    """Values by text key, as a literal array of maps; a key's place is its hash."""

    buckets: Column
    size: int

    def __getitem__(self, key: Column) -> Column:
        at = F.xxhash64(key).bitwiseAND(F.lit(self.size - 1)).cast("int")
        return self.buckets[at][key]

    def named(self, use) -> Column:
        """``use`` of the same values under a name, so that an expression holds the literal once."""
        return _let(self.buckets, lambda buckets: use(Literal(buckets, self.size)))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a fold of nothing, as an item of an array derives its type for each row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda same, _: same, use)


def literal(values: dict[str, object], kind: str) -> Literal:
    size = 1 << len(values).bit_length()
    buckets: list[dict] = [{} for _ in range(size)]
    for key, value in values.items():
        buckets[xxhash.xxh64_intdigest(key.encode(), seed=42) & (size - 1)][key] = value
    return Literal(F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), f"array<map<string,{kind}>>"), size)


def _texts(values: Sequence[str]) -> Column:
    return F.from_json(F.lit(json.dumps(list(values), ensure_ascii=False)), "array<string>")


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines with a piece in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}


@dataclass(frozen=True)
class Ranks:
    """Ranks of joined pieces by the ids of two pieces, as literals.

    A pair's number is ``left * 2**bits + right``; an entry is that number and, behind it, the rank in ``bits`` bits.
    """

    arrays: tuple[Column, Column]
    sizes: tuple[int, int]
    byte_ids: Column
    bits: int

    def __getitem__(self, pair: tuple[Column, Column]) -> Column:
        number = F.shiftleft(pair[0], self.bits) + pair[1]
        found = [a[number % F.lit(n).cast("long")] for a, n in zip(self.arrays, self.sizes, strict=True)]
        ranked = [F.when(F.shiftright(e, self.bits) == number, e.bitwiseAND(F.lit((1 << self.bits) - 1))) for e in found]
        return F.coalesce(*ranked)

    def named(self, use) -> Column:
        """``use`` of the same values under names, so that an expression holds each literal once."""
        return _let(self.arrays[0], lambda a: _let(self.arrays[1], lambda b: _let(self.byte_ids, lambda c: use(Ranks((a, b), self.sizes, c, self.bits)))))


def _prime_from(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def place_entries(entries: list[tuple[int, int]]) -> tuple[tuple[list[int], list[int]], tuple[int, int]]:
    """Places for entries (number, whole entry) in two arrays, each at its number modulo the size of one of them.

    An entry that takes another's place sends that one to its place in the other array; a ring of these makes the
    arrays larger.
    """
    size = len(entries) + 2
    while True:
        sizes = (_prime_from(size), _prime_from(size + size // 7 + 1))
        arrays: list[dict[int, tuple[int, int]]] = [{}, {}]
        for entry in entries:
            side = 0
            for _ in range(200):
                at = entry[0] % sizes[side]
                entry, arrays[side][at] = arrays[side].get(at), entry
                if entry is None:
                    break
                side = 1 - side
            if entry is not None:
                break
        else:
            return tuple([arrays[k].get(i, (0, -1))[1] for i in range(sizes[k])] for k in (0, 1)), sizes
        size += size // 2


# Behind the characters of all ids: no rank.
NONE = chr(0x10FFFF)
_SURROGATES, _BEHIND = 0xD800, 0x801


def character(number: int) -> str:
    """An id as a character. Characters have the order of the ids; U+0000 and the surrogates are left out."""
    return chr(number + 1 if number + 1 < _SURROGATES else number + _BEHIND)


def numbers(text: Column) -> Column:
    """The ids of a text's characters."""
    code = lambda c: F.when(F.ascii(c) < _SURROGATES, F.ascii(c) - 1).otherwise(F.ascii(c) - _BEHIND)
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), code))


@dataclass(frozen=True)
class Merges:
    """The merged piece's character by the two characters of a pair, as a literal, and the characters of the bytes."""

    pairs: Literal
    bytes: Column
    edge: str

    def __getitem__(self, pair: Column) -> Column:
        return F.coalesce(self.pairs[pair], F.lit(NONE))

    def named(self, use) -> Column:
        """``use`` of the same values under a name, so that an expression holds the literal once."""
        return self.pairs.named(lambda pairs: use(Merges(pairs, self.bytes, self.edge)))


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of pieces and the pattern that cuts texts into words. Every single byte must have a rank."""

    path: str
    pattern: str

    def ranks(self) -> Ranks:
        ranks = read_ranks(self.path)
        bits = max(ranks.values()).bit_length()
        pairs = [
            (ranks[piece[:cut]] << bits | ranks[piece[cut:]], rank)
            for piece, rank in ranks.items()
            for cut in range(1, len(piece))
            if piece[:cut] in ranks and piece[cut:] in ranks
        ]
        arrays, sizes = place_entries([(number, number << bits | rank) for number, rank in pairs])
        a, b, byte_ids = (F.from_json(F.lit(json.dumps(x)), "array<bigint>") for x in (*arrays, [ranks[bytes([i])] for i in range(256)]))
        return Ranks((a, b), sizes, byte_ids, bits)

    def merges(self) -> Merges:
        ranks = read_ranks(self.path)
        pairs = {
            character(ranks[piece[:cut]]) + character(ranks[piece[cut:]]): character(rank)
            for piece, rank in ranks.items()
            for cut in range(1, len(piece))
            if piece[:cut] in ranks and piece[cut:] in ranks
        }
        return Merges(literal(pairs, "string"), F.lit("".join(character(ranks[bytes([i])]) for i in range(256))), character(max(ranks.values()) + 1))

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(self.pattern)), F.lit(0))

    def pieces(self) -> list[str]:
        by_id = {r: p.decode("latin-1") for p, r in read_ranks(self.path).items()}
        return [by_id.get(i, "") for i in range(max(by_id) + 1)]


def java_pattern(pattern: str) -> str:
    r"""The pattern with Unicode's white space for ``\s`` and ``\S``, inside and outside classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            if inside and two == r"\S":
                raise ValueError(r"\S inside a class")
            out.append(WHITE if inside else f"[{'^' * (two == chr(92) + 'S')}{WHITE}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i += 1
    return "".join(out)


_BYTES = "".join(map(chr, range(256)))


def _one_by_one(word: Column, merges: Merges) -> Column:
    """The ids of a word, as text: the leftmost pair of the lowest rank is merged, again and again.

    ``ids`` has ``edge`` before and behind the word's; ``ranks`` has the rank of each of its characters with the next.
    """
    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")

    def state(ids, ranks):
        return F.struct(ids.alias("ids"), ranks.alias("ranks"), F.array_min(F.split(ranks, "")).alias("low"))

    def begin(ids):
        each = F.transform(F.sequence(F.lit(1), F.length(ids) - 1), lambda i: merges[F.substring(ids, i, F.lit(2))])
        return _let(F.array_join(each, ""), lambda ranks: state(ids, ranks))

    def merge(s, _):
        def at(i):
            def merged(ids):
                two = F.concat(merges[F.substring(ids, i - 1, F.lit(2))], merges[F.substring(ids, i, F.lit(2))])
                return _let(F.overlay(s["ranks"], two, i - 1, F.lit(3)), lambda ranks: state(ids, ranks))

            return _let(F.overlay(s["ids"], s["low"], i, F.lit(2)), merged)

        return F.when(s["low"] == NONE, s).otherwise(_let(F.instr(s["ranks"], s["low"]), at))

    ids = F.concat(F.lit(merges.edge), F.call_function("translate", latin, F.lit(_BYTES), merges.bytes), F.lit(merges.edge))
    return F.aggregate(F.split(latin, ""), _let(ids, begin), merge, lambda s: F.substring(s["ids"], F.lit(2), F.length(s["ids"]) - 2))


def _byte_ids(word: Column, ranks: Ranks) -> Column:
    """The ids of a word's bytes."""
    one_each = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    return F.transform(one_each, lambda c: ranks.byte_ids[F.ascii(c)])


def _state(ids: Column, ranks: Ranks) -> Column:
    """Ids, and the place of each pair in the order of merges: its rank with its position behind it, null without a rank."""
    order = F.transform(ids, lambda x, i: F.shiftleft(ranks[x, F.get(ids, i + 1)], 32) + i)
    return _let(order, lambda o: F.struct(ids.alias("ids"), o.alias("order"), F.array_min(o).alias("first")))


_POSITION = (1 << 32) - 1


def _one_merge(state: Column, ranks: Ranks) -> Column:
    """The leftmost pair of the lowest rank is merged."""
    at, new = state["first"].bitwiseAND(F.lit(_POSITION)), F.shiftright(state["first"], 32)
    merged = F.transform(state["ids"], lambda x, i: F.when(i == at, new).when(i != at + 1, x))
    return _let(F.filter(merged, lambda x: x.isNotNull()), lambda ids: _state(ids, ranks))


def _all_merges(state: Column, ranks: Ranks) -> Column:
    """All pairs of the lowest rank are merged from left to right, or the leftmost if that could make a lower one."""
    ids, low = state["ids"], F.shiftright(state["first"], 32)
    # One character per pair: 1 is merged. Of pairs that share a piece the left one is.
    hits = F.transform(state["order"], lambda o: F.when(F.shiftright(o, 32).eqNullSafe(low), "1").otherwise("0"))
    mask = F.split(F.replace(F.array_join(hits, ""), F.lit("11"), F.lit("12")), "")

    def tried(mask):
        merged = F.transform(ids, lambda x, i: F.when(mask[i] == "1", low).when((i == 0) | (F.get(mask, i - 1) != "1"), x))
        lower = F.exists(  # does a merged pair, with the left piece of the next one, have a lower rank?
            F.sequence(F.lit(0), F.size(ids) - 1),
            lambda i: (mask[i] == "1") & F.get(mask, i + 2).eqNullSafe("1") & F.coalesce(ranks[low, F.get(ids, i + 2)] < low, F.lit(False)),
        )
        after = _let(F.filter(merged, lambda x: x.isNotNull()), lambda new: _state(new, ranks))
        return _let(after, lambda s: F.when(~lower & (F.coalesce(F.shiftright(s["first"], 32), low) >= low), s))

    return F.coalesce(_let(mask, tried), _one_merge(state, ranks))


def _many_at_once(word: Column, ranks: Ranks) -> Column:
    """The ids of a word, as text."""

    def run(ids):
        merge = lambda state, _: F.when(state["first"].isNull(), state).otherwise(_all_merges(state, ranks))
        return F.aggregate(ids, _state(ids, ranks), merge, lambda s: s["ids"])

    code = lambda i: F.when(i + 1 < _SURROGATES, i + 1).otherwise(i + _BEHIND)
    character_of = lambda i: F.decode(F.unhex(F.lpad(F.hex(code(i)), 8, "0")), "UTF-32")
    return F.array_join(F.transform(_let(_byte_ids(word, ranks), run), character_of), "")


def fold(word: Column, merges: Merges, ranks: Ranks) -> Column:
    """The ids of a word, as text."""
    return F.when(F.octet_length(word) <= SHORT, _one_by_one(word, merges)).otherwise(_many_at_once(word, ranks))


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, rows: int = SAMPLE_ROWS, words: int = TABLE_WORDS) -> Literal:
    """Ids of the ``words`` most frequent short words of about ``rows`` documents, picked by a hash of their text."""
    share = rows / max(1, docs.count())
    picked = docs if share >= 1 else docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))
    counted = picked.select(F.explode(vocabulary.words(F.col("text"))).alias("word")).groupBy("word").count()
    most = counted.where(F.octet_length("word") <= SHORT).orderBy(F.desc("count"), "word").limit(words)
    found = most.select("word", vocabulary.merges().named(lambda merges: _one_by_one(F.col("word"), merges)).alias("ids")).collect()
    return literal({r["word"]: r["ids"] for r in found}, "string")


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: Sequence[str], table: Literal | None = None) -> DataFrame:
    """``keep`` columns and ``ids`` (an array of int) of every whole ``text``."""
    kept, inner, back = carry(keep, ["ids"])
    moved = docs.select(*kept, F.col("text").cast("string").alias("text_to_encode"))
    table = table or frequent_words(docs.select(F.col("text").cast("string").alias("text")), vocabulary)
    words = vocabulary.words(F.col("text_to_encode"))
    each = lambda known, merges, ranks: F.transform(words, lambda w: F.coalesce(known[w], fold(w, merges, ranks)))
    of_words = table.named(lambda known: vocabulary.merges().named(lambda merges: vocabulary.ranks().named(lambda ranks: each(known, merges, ranks))))
    joined = moved.select(*inner, F.array_join(of_words, "").alias("ids_as_text"))
    return back(joined.select(*inner, numbers(F.col("ids_as_text")).alias("ids")))


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and the bytes (``data``) of ``ids``."""
    kept, inner, back = carry(keep, ["data"])
    moved = encoded.select(*kept, F.col("ids").cast("array<int>").alias("ids_to_decode"))
    return back(moved.select(*inner, joined_bytes(F.col("ids_to_decode"), vocabulary.pieces()).alias("data")))


def joined_bytes(ids: Column, pieces: Sequence[str]) -> Column:
    """The bytes of the pieces with these numbers, joined."""
    by_id = _texts(pieces)
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(by_id, i)), ""), "ISO-8859-1")


def little_endian(ids: Column, size: int) -> Column:
    """Ids below ``size`` as little-endian unsigned 32-bit numbers."""
    return joined_bytes(ids, [struct.pack("<I", i).decode("latin-1") for i in range(size)])
