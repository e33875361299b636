"""Quality classifier: how much better a text compresses with a dictionary of good text than of bad.

Two zstandard dictionaries are built, one from good and one from bad labelled
text. A text is cut into blocks, each block is compressed with either
dictionary, and the sizes are summed. The difference of the two sums over
their mean, together with the compression rate, goes through a logistic
calibration that was fitted on labelled rows no dictionary has seen.

Defined results: a null text counts as empty. An empty text has no
difference and gets the calibrated score of two equal sizes. With no usable
labels, or labels of one class only, every text gets the share of good labels
(one half without any). Equal texts get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import sampling
from tidemark.llm.arrow import filter_texts, map_texts
from tidemark.llm.columns import carry, types_of

# Rows of the labelled sample the model is fitted on, per class; their texts are taken whole. It does not grow with
# the tables.
SAMPLE_ROWS = 2500

BLOCK_BYTES = 4096
DICTIONARY_BYTES = 256 * 1024
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration; ``good`` and ``bad`` are empty if ``prior`` is all that is known."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


@lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def blocks(text: bytes) -> list[bytes]:
    """The text in pieces of ``BLOCK_BYTES``, which are compressed each by itself."""
    return [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]


def compressed_sizes(text: bytes, dictionary: bytes) -> int:
    """Bytes of all blocks of the text, each compressed by itself with the dictionary."""
    squeeze = _compressor(dictionary).compress
    return sum(len(squeeze(block)) for block in blocks(text))


def features(text: str | None, good: bytes, bad: bytes) -> tuple[float, ...]:
    """Constant, normalised difference, its cube root's scale, and the compression rate with its square."""
    data = (text or "").encode()
    if not data:
        return (1.0, 0.0, 0.0, 0.0, 0.0)
    by_good, by_bad = compressed_sizes(data, good), compressed_sizes(data, bad)
    difference = (by_bad - by_good) / (by_bad + by_good)
    rate = (by_bad + by_good) / (2 * len(data)) - 0.5
    return (1.0, difference, difference * rate, rate, rate * rate)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method; a small ridge keeps separable data finite."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w
        )
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(samples: list[bytes]) -> bytes | None:
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 2)
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return None


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on ``docs`` that have a label: at most ``SAMPLE_ROWS`` per class, those with the smallest hash of their id.

    The sample is picked among the labels, so that only the picked texts are moved. Two rows of three build the
    dictionaries, a whole text being one sample; the others calibrate with their whole texts, as texts are scored,
    weighted so that the classes count as they do among all labels.
    """
    counts = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    nothing = QualityModel(b"", b"", (), prior)
    picked = {q: sampling.first_in_order(labels.where(F.col("quality") == q), SAMPLE_ROWS) for q in (0, 1)}
    texts = sampling.texts_at(docs, picked[0] + picked[1])
    rows = {q: [texts[p].encode() for p in picked[q] if p in texts] for q in (0, 1)}
    if not (rows[0] and rows[1]):
        return nothing
    bad, good = (_dictionary([t for i, t in enumerate(rows[q]) if i % 3]) for q in (0, 1))
    if not (good and bad):
        return nothing
    x, y, weight = [], [], []
    for q in (0, 1):
        held = rows[q][::3]
        x += [features(t.decode(), good, bad) for t in held]
        y += [q] * len(held)
        weight += [counts[q] / total * 2000 / len(held)] * len(held)
    weights = _logistic(np.array(x), np.array(y, float), np.array(weight))
    return QualityModel(good, bad, tuple(map(float, weights)), prior)


def score_text(text: str | None, model: QualityModel) -> float:
    if not model.good:
        return model.prior
    z = sum(w * x for w, x in zip(model.weights, features(text, model.good, model.bad), strict=True))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` (clashes: see ``columns``) and ``score``: the estimated chance that the text is good.
    ``text`` is read whole."""
    kept, inner, back = carry(keep, ["score"])
    moved = docs.select(*kept, F.col("text").alias("text_to_score"))
    types = types_of(moved.select(*inner, F.lit(0.0).alias("score")))

    def work(*columns):
        return dict(zip(inner, columns, strict=False)) | {"score": [score_text(t, model) for t in columns[-1]]}

    return back(map_texts(moved, types, work))


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``."""
    return filter_texts(docs, lambda texts: [score_text(t, model) >= least for t in texts])


def training_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, quality)`` of the labels that may be learned from: crc32(doc_id as text) mod 3 is not 1.

    A document labelled more than once counts with its lowest label; labels but 0 and 1 are no labels.
    """
    known = labels.where("doc_id is not null and quality in (0, 1) and crc32(cast(doc_id as string)) % 3 <> 1")
    return known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
