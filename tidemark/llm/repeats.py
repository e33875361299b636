"""Which hashes occur in more than one batch: hashes go to buckets as packed arrays, answers come back as bits.

A batch sends each hash once to the bucket that its value picks, in an order
the batch can make again. The bucket answers with one bit per hash. A hash
that stands for a third of all rows costs a bucket one entry per batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SENT = "batch long, bucket long, hashes binary, ids binary, many binary"
SENT_ARROW = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("ids", pa.binary()), ("many", pa.binary())])
SAID = "batch long, bucket long, bits binary"
SAID_ARROW = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])


def bucket_edges(n: int) -> np.ndarray:
    return np.array([(i << 64) // n for i in range(1, n)], np.uint64)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def received(table: pa.Table) -> tuple[list[int], list[int], np.ndarray]:
    """Batches in order, each one's number of hashes, and all hashes."""
    hashes = [np.frombuffer(h, np.uint64) for h in table["hashes"].to_pylist()]
    return table["batch"].to_pylist(), [len(h) for h in hashes], np.concatenate(hashes)


def answer(bucket: int, batches: list[int], sizes: list[int], flags: np.ndarray) -> pa.Table:
    cut = np.cumsum([0, *sizes])
    bits = [pack_bits(flags[s:e]) for s, e in zip(cut, cut[1:], strict=False)]
    return pa.Table.from_arrays([pa.array(batches, pa.int64()), pa.array([bucket] * len(batches), pa.int64()), pa.array(bits, pa.binary())], schema=SAID_ARROW)


def repeated(table: pa.Table) -> pa.Table:
    """Of each hash a batch sent: does it occur elsewhere, or more than once there?"""
    if table["bucket"][0].as_py() < 0:
        return pass_on(table)
    batches, sizes, hashes = received(table)
    many = np.concatenate([unpack_bits(m, n) for m, n in zip(table["many"].to_pylist(), sizes, strict=True)])
    _, place, count = np.unique(hashes, return_inverse=True, return_counts=True)
    return answer(table["bucket"][0].as_py(), batches, sizes, (count > 1)[place] | many)



def send(batch: int, found: np.ndarray, many: np.ndarray, n_buckets: int, extra: list[tuple[int, bytes]] = ()) -> pa.Table:
    """Rows of a batch for its sorted distinct hashes. ``extra`` (bucket below 0, bytes) goes along as it is."""
    cut = cuts(found, n_buckets)
    rows = [(b, s, e) for b, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > s]
    columns = [
        [batch] * (len(rows) + len(extra)),
        [*(b for b, _, _ in rows), *(b for b, _ in extra)],
        [*(found[s:e].tobytes() for _, s, e in rows), *[b""] * len(extra)],
        [b""] * (len(rows) + len(extra)),
        [*(pack_bits(many[s:e]) for _, s, e in rows), *(x for _, x in extra)],
    ]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SENT_ARROW, strict=True)], schema=SENT_ARROW)


def pass_on(table: pa.Table) -> pa.Table:
    """What came under a bucket below 0 goes back as it is."""
    return table.select(["batch", "bucket", "many"]).rename_columns(["batch", "bucket", "bits"])


def flags_of(found: np.ndarray, answers: list[tuple[int, bytes]], n_buckets: int) -> np.ndarray:
    """The answers to a batch's sorted distinct hashes, in their order."""
    flags, cut = np.zeros(len(found), bool), cuts(found, n_buckets)
    for bucket, bits in answers:
        flags[cut[bucket] : cut[bucket + 1]] = unpack_bits(bits, cut[bucket + 1] - cut[bucket])
    return flags


def cuts(found: np.ndarray, n_buckets: int) -> list[int]:
    """Where the hashes of each bucket begin among sorted ones, with the end."""
    return [0, *np.searchsorted(found, bucket_edges(n_buckets)), len(found)]
