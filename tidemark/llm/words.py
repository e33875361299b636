"""Words of many texts at once as 64-bit hashes, and hashes of runs of words, in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return. Hashes are polynomial in the bytes (and, for runs,
in the word hashes) modulo 2**64, then mixed; equal words have equal hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


_LONGEST_KEPT = 1 << 21


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_LONGEST_KEPT)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        steps = np.full(size, np.uint64(base))
        steps[:1] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def _table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for at least ``size`` places. A worker keeps one table of bounded size; longer ones are made when needed."""
    return _kept_powers() if size <= _LONGEST_KEPT else _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, where words start and end in them, and each text's first word (with the total at the end)."""
    joined = b"\n".join(texts) + b"\n"
    white = _WHITE[np.frombuffer(joined, np.uint8)]
    edge = np.flatnonzero(np.diff(white, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return joined, starts, ends, np.searchsorted(starts, text_at)


def word_hashes(texts: list[bytes], fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and each text's first word (with the total at the end)."""
    joined, starts, ends, first = word_spans(texts)
    data = (_FOLDED if fold_case else _BYTE)[np.frombuffer(joined, np.uint8)]
    power, inverse = _table(len(data))
    data *= power[: len(data)]
    np.cumsum(data, out=data)
    head = np.where(starts > 0, data[starts - 1], np.uint64(0))
    return mix((data[ends - 1] - head) * inverse[starts] + (ends - starts).astype(np.uint64)), first


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` successive words, by where they start (runs across texts included)."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    power, inverse = _table(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)], dtype=np.uint64)])
    n = len(words) - k + 1
    return mix((sums[k:] - sums[:-k]) * inverse[:n])


def inside_texts(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over ``run_hashes(words, k)``: runs that lie within one text."""
    total = int(first[-1])
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    for end in np.unique(first[1:]):  # runs that start in the last k - 1 words before an end cross it
        ok[max(0, end - k + 1) : min(n, end)] = False
    return ok


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over every ``width`` successive values."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = pick(out[:-have], out[have:]), 2 * have
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out
