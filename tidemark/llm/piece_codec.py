"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces and one pass over each text.

The automaton reports, at each position, every piece that ends there, by
following its output links. One pass keeps the best way to each position:

* for a unigram model, the piece that gives the largest sum of scores (Viterbi);
* for a BPE model, the piece that the model's merges end the prefix with. It is
  the one that is compatible with the piece the rest of the prefix ends with:
  merging the two pieces' text gives these two again. There is exactly one, so
  the pass gives the ids the model's merges give.

White space becomes the piece mark, a mark is put in front, and characters
that no piece has fall back to their bytes. Texts are cut where no piece
reaches across, and what lies between is remembered per worker.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to itself. Unknown ids and those of control pieces decode to nothing.
Bytes that are no UTF-8 decode to the replacement character.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_texts
from tidemark.llm.columns import carry, types_of

MARK = "▁"
REMEMBERED = 500_000  # words, and parts of words, per worker
UNIGRAM, BPE = 1, 2
NORMAL, BYTE = 1, 6
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Codec(dict):
    """Ids of the words of a text (from a run of marks to the next one) as 32-bit integers, remembered."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int):
        super().__init__()
        self.kind, self.pieces = kind, pieces
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.score = [s for _, s, _ in pieces]
        self.byte = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == 2), 0)
        self.shown = [p.replace(MARK, " ").encode() if t == NORMAL else bytes([int(p[1:-1], 16)]) if t == BYTE else b"" for p, _, t in pieces]
        # Two characters that are neighbours in no piece are never in the same one.
        self.together = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.parts: dict[str, bytes] = {}
        self.alone: dict[int, bool] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        # Pieces of marks alone may tie in score; runs of marks are then merged as they stand.
        self.tied = kind == BPE and any(set(p) == {MARK} and len(p) > 1 for p in self.ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        cut = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.together), len(word)]
        found = self[word] = b"".join([self._part(word[a:b]) for a, b in zip(cut, cut[1:], strict=False)])
        return found

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            found = self.parts[part] = array("i", self._pass(part)).tobytes()
        return found

    def _pass(self, part: str) -> list[int]:
        if len(part) == 1 and part not in self.ids:
            return [self.byte.get(b, self.unknown) for b in part.encode()]
        if self.tied and MARK * 2 in part:
            return self.merged(part)
        return self._viterbi(part) if self.kind == UNIGRAM else self._compatible(part)

    def _viterbi(self, part: str) -> list[int]:
        best = [(0.0, -1, 0)] + [(-np.inf, -1, 0)] * len(part)
        lowest = min(self.score) - 10
        for end in range(len(part)):  # a character without a piece costs more than any piece
            best[end + 1] = (-np.inf, -1, 1)
        reached = 0
        for end, (i, n) in self._matches(part):
            while reached < end:
                self._step_over(best, reached, lowest)
                reached += 1
            value = best[end + 1 - n][0] + self.score[i]
            if value > best[end + 1][0]:
                best[end + 1] = (value, i, n)
        while reached < len(part):
            self._step_over(best, reached, lowest)
            reached += 1
        out, at = [], len(part)
        while at:
            _, i, n = best[at]
            out.append([i] if i >= 0 else [self.byte.get(b, self.unknown) for b in part[at - 1].encode()])
            at -= n
        return [i for ids in reversed(out) for i in ids]

    @staticmethod
    def _step_over(best, at: int, lowest: float) -> None:
        if best[at][0] + lowest > best[at + 1][0]:
            best[at + 1] = (best[at][0] + lowest, -1, 1)

    def _matches(self, part: str):
        return self.automaton.iter(part)

    def _compatible(self, part: str) -> list[int]:
        last, size = [-1] * (len(part) + 1), [0] * (len(part) + 1)
        for end, (i, n) in self._matches(part):
            if last[end + 1] >= 0:
                continue
            before = last[end + 1 - n]
            if (self._stands(i) if end + 1 == n else before >= 0 and self._fit(before, i)):
                last[end + 1], size[end + 1] = i, n
        if last[-1] < 0:
            return self.merged(part)
        out, at = [], len(part)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _stands(self, i: int) -> bool:
        if i not in self.alone:
            self.alone[i] = self.merged(self.pieces[i][0]) == [i]
        return self.alone[i]

    def _fit(self, a: int, b: int) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            found = self.fits[a, b] = self.merged(self.pieces[a][0] + self.pieces[b][0]) == [a, b]
        return found

    def merged(self, text: str) -> list[int]:
        """Ids by the model's merges: the adjacent pair whose joined piece scores best, the leftmost first."""
        parts, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours of the parts that are left
        waiting: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            i = self.ids.get(parts[a] + parts[b])
            if i is not None:
                heappush(waiting, (-self.score[i], a, len(parts[a]), len(parts[b])))

        for k in range(n - 1):
            offer(k, k + 1)
        while waiting:
            _, a, long, next_long = heappop(waiting)
            b = after[a]
            if len(parts[a]) != long or b >= n or len(parts[b]) != next_long:  # one of the two has been merged meanwhile
                continue
            parts[a], parts[b], after[a] = parts[a] + parts[b], "", after[b]
            if after[a] < n:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return [x for p in filter(None, parts) for x in ([self.ids[p]] if p in self.ids else [self.byte.get(b, self.unknown) for b in p.encode()])]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        words = _WORDS.findall(MARK + text.replace(" ", MARK))
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32)

    def decode(self, ids) -> str:
        known = len(self.shown)
        data = b"".join([self.shown[i] for i in ids if 0 <= i < known])
        return data[1:].decode(errors="replace") if data.startswith(b" ") else data.decode(errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a model file, which every machine has at the same path."""
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    model = model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    if model.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models have scored pieces")
    return Codec([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type)


def encode(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns (clashes: see ``columns``) and ``ids`` of every whole ``text``."""
    kept, inner, back = carry(keep, ["ids"])
    moved = docs.select(*kept, F.col("text").alias("text_to_encode"))

    def work(*columns):
        own = codec(path)
        return dict(zip(inner, columns, strict=False)) | {"ids": [own.encode(t or "") for t in columns[-1]]}

    return back(map_texts(moved, types_of(moved.select(*inner, F.expr("cast(null as array<int>) as ids"))), work))


def decode(encoded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns (clashes: see ``columns``) and the ``text`` of ``ids``; null ids have a null text."""
    kept, inner, back = carry(keep, ["text"])
    moved = encoded.select(*kept, F.col("ids").alias("ids_to_decode"))

    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch["ids_to_decode"].to_pylist()]
            columns = [batch[c] for c in inner]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*inner, "text"])

    return back(moved.mapInArrow(run, types_of(moved.select(*inner, F.lit("").alias("text")))))


def encode_and_check(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """As ``encode``, with ``round_trip``: does decoding the ids give the text again? A text that itself holds the piece
    mark does not."""
    kept, inner, back = carry(keep, ["ids", "round_trip"])
    moved = docs.select(*kept, F.col("text").alias("text_to_encode"))

    def work(*columns):
        own, ids, same = codec(path), [], []
        for text in columns[-1]:
            ids.append(own.encode(text or ""))
            same.append(own.decode(ids[-1].tolist()) == (text or ""))
        return dict(zip(inner, columns, strict=False)) | {"ids": ids, "round_trip": same}

    return back(map_texts(moved, types_of(moved.select(*inner, F.expr("cast(null as array<int>) as ids"), F.lit(True).alias("round_trip"))), work))
