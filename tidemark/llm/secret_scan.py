"""Secrets: base patterns, and strings that look more random than ordinary by two character Markov models.

Base spans (assignments, access keys, long hexadecimal runs) are found by
fixed patterns and always stay. Every further run of 12 or more key-like
characters is scored by the log-likelihood ratio of two character Markov
models of order two, one of random strings and one of ordinary identifiers,
summed over its characters, and taken if the sum reaches the threshold.

What the models learn is counted over all documents: how often a character
follows the two before it. Labels come from form. Values of base matches are
random, as are strings drawn with a fixed seed from the alphabets that keys
use. All other runs are ordinary but those of 12 or more characters that mix
letters and digits, which are left unlabelled; and so is each text once more
with its words joined as code joins them. A quarter of the documents (by a
hash of their text) is held out of the counts: the threshold is a quantile of
the sums of all its ordinary runs of 12 or more characters and of its joined
words, and at least ``LEAST``.

Spark's part: a task adds up its documents' counts, of which there are at most
one per two characters and next character, whatever it reads; the sums of all
tasks (at most that many again) and one quantile come to the driver.

Defined results: a null text counts as empty and has no spans. Positions are
code points, ends exclusive. Equal texts have equal spans; a repeated row
counts again in the models. Very long texts take time in proportion. Without
documents the random strings and a flat ordinary model remain, and nothing is
added. Clashing names of kept columns: see ``columns``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_texts, slices
from tidemark.llm.columns import carry, types_of
from tidemark.llm.spans import Spans

KINDS = ("assign", "access", "hex")
ADDED = "random"

LONG = 12  # characters of a run that is scored
LEAST = 8.0  # log-likelihood by which a random string must be likelier, at least
QUANTILE = 0.995  # of the held-out ordinary runs that must stay below the threshold
DRAWN = 3000

# Fixed patterns of the base spans.
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

# Runs of key-like characters that the models look at.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
_WORD = re.compile(r"[A-Za-z]{3,}")
_THREE = re.compile(r"[A-Za-z]{3,}(?:\x20[A-Za-z]{3,}){2}")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_START = len(ALPHABET)  # stands for what comes before the start
_N = _START + 1
_CODE = np.full(256, -1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(_START)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind as listed."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def runs(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of key-like characters that overlap no base span."""
    found, base = [m.span() for m in _RUN.finditer(text)], Spans(s[1:] for s in taken)
    return [r for r in found if not base.overlap(*r)] if taken else found


def _cells(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where runs have a character, and the numbers of (two characters before, character) there; any other byte ends a run."""
    codes = _CODE[np.frombuffer(data, np.uint8)]
    inside = codes >= 0
    last = np.full(len(codes), _START)
    last[1:][inside[:-1]] = codes[:-1][inside[:-1]]
    second = np.full(len(codes), _START)
    second[1:][inside[:-1]] = last[:-1][inside[:-1]]
    at = np.flatnonzero(inside)
    return at, (second[at] * _N + last[at]) * _START + codes[at]


@dataclass(frozen=True)
class SecretModel:
    """Log-likelihood ratios by (two characters before, character), and the sum that a run must reach."""

    ratio: np.ndarray
    threshold: float

    def scores(self, runs: list[str]) -> np.ndarray:
        """The sums of the ratios over each run (no run is empty)."""
        if not runs:
            return np.empty(0)
        _, cells = _cells(" ".join(runs).encode("ascii"))
        return np.add.reduceat(self.ratio.ravel()[cells], np.cumsum([0, *map(len, runs[:-1])]))

    def score(self, run: str) -> float:
        return float(self.scores([run])[0])


def _log_likelihood(counts: np.ndarray) -> np.ndarray:
    """Log probabilities by context; thin contexts lean on the one-character context, and that on single characters."""
    single = counts.sum(0) + 0.5
    single /= single.sum()
    by_last = counts.reshape(_N, _N, _START).sum(0) + 4 * single
    by_last /= by_last.sum(1, keepdims=True)
    smooth = counts + 4 * np.tile(by_last, (_N, 1))
    return np.log(smooth / smooth.sum(1, keepdims=True))


def _draw(rng: np.random.Generator, n: int) -> list[str]:
    alphabets = [ALPHABET[:62], ALPHABET[:64], ALPHABET[:36], ALPHABET[26:62], "0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62] + "_-"]
    return ["".join(rng.choice(list(alphabets[i % len(alphabets)]), rng.integers(LONG, 65))) for i in range(n)]


def _joined(words: str, style: int) -> str:
    """Words between spaces as code joins them."""
    if style < 2:
        return words.title().replace(" ", "")
    return (words.upper() if style == 2 else words).replace(" ", "__-/="[style - 2])


def _labelled(text: str) -> tuple[bytes, list[str]]:
    """The text with spaces for base spans and for long runs that mix letters and digits, one byte per code point; and the base spans' values."""
    data = bytearray(text.encode("ascii", "replace"))
    spans = base_spans(text)
    values = [_ASSIGN.match(text, s).group(2) if kind == "assign" else text[s:e] for kind, s, e in spans]
    mixed = [m.span() for m in _RUN.finditer(text) if _DIGIT.search(m.group()) and _LETTER.search(m.group())]
    for start, end in [s[1:] for s in spans] + mixed:
        data[start:end] = b" " * (end - start)
    return bytes(data), values


def _held_out(text: str) -> bool:
    return zlib.crc32(text.encode("utf-8", "replace")) % 4 == 0


def _style(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) // 4 % 6


def _counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each character follows the two before it, in ordinary and in random strings of all documents not held out."""
    size = _N * _N * _START

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size), np.int64)
        for batch in batches:
            for (texts,) in slices(batch.columns, 0):
                plain, joined, values = [], [], []
                for text in texts:
                    if text and not _held_out(text):
                        data, found = _labelled(text)
                        plain.append(data)
                        values += found
                        joined.append(_joined(" ".join(_WORD.findall(data.decode("ascii"))), _style(text)).encode("ascii"))
                for part, strings in ((0, plain + joined), (1, [v.encode("ascii") for v in values])):
                    found, many = np.unique(_cells(b" ".join(strings))[1], return_counts=True)
                    sums[part, found] += many
        part, cell = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cell), pa.array(sums[part, cell])], names=["part", "cell", "n"])

    sent = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "part long, cell long, n long")
    table = sent.groupBy("part", "cell").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((2, size))
    sums[table["part"].to_numpy(), table["cell"].to_numpy()] = table["n"].to_numpy()
    return sums[0].reshape(-1, _START), sums[1].reshape(-1, _START)


def _threshold(docs: DataFrame, model: SecretModel) -> float:
    """The quantile of the sums of all held-out ordinary runs."""

    def work(texts: list[str | None]) -> dict[str, list]:
        found = []
        for text in texts:
            if text and _held_out(text):
                plain = _labelled(text)[0].decode("ascii")
                found += _RUN.findall(plain)
                found += [j for m in _THREE.findall(plain) if len(j := _joined(m, _style(text))) >= LONG]
        return {"score": model.scores(found).tolist()}

    scores = map_texts(docs.select(F.col("text").cast("string").alias("text")), "score double", work)
    worst = scores.agg(F.percentile_approx("score", QUANTILE, 10_000)).first()[0]
    return LEAST if worst is None else max(worst, LEAST)


def fit(docs: DataFrame) -> SecretModel:
    """Train on all documents: one pass counts, another one finds the threshold."""
    ordinary, values = _counts(docs)
    if not ordinary.any():
        return SecretModel(np.zeros((_N * _N, _START)), float("inf"))
    random = np.zeros(_N * _N * _START)
    np.add.at(random, _cells(" ".join(_draw(np.random.default_rng(7), DRAWN)).encode("ascii"))[1], 1)
    # The values of base matches count as much as the drawn strings at most, however many there are.
    share = min(1.0, random.sum() / max(1.0, values.sum()))
    ratio = _log_likelihood(random.reshape(-1, _START) + share * values) - _log_likelihood(ordinary)
    return SecretModel(ratio, _threshold(docs, SecretModel(ratio, 0.0)))


def added_spans(text: str, base: list[tuple[str, int, int]], model: SecretModel) -> list[tuple[str, int, int]]:
    found = runs(text, base)
    scores = model.scores([text[s:e] for s, e in found])
    return [(ADDED, *found[i]) for i in np.flatnonzero(scores >= model.threshold).tolist()]


SPAN = "array<struct<kind: string, start: int, end: int>>"


def find(docs: DataFrame, keep: list[str], model: SecretModel) -> DataFrame:
    """``keep`` columns (clashes: see ``columns``), ``base`` and ``added`` spans of every whole ``text``."""
    kept, inner, back = carry(keep, ["base", "added"])
    moved = docs.select(*kept, F.col("text").alias("text_to_scan"))
    types = types_of(moved.select(*inner, F.expr(f"cast(null as {SPAN}) as base"), F.expr(f"cast(null as {SPAN}) as added")))

    def work(*columns):
        base, added = [], []
        for text in columns[-1]:
            spans = base_spans(text or "")
            more = added_spans(text or "", spans, model)
            for out, part in ((base, spans), (added, more)):
                out.append([{"kind": k, "start": s, "end": e} for k, s, e in part])
        return dict(zip(inner, columns, strict=False)) | {"base": base, "added": added}

    return back(map_texts(moved, types, work))
