"""Parity sketches of sets of shingles.

A sketch tells for each bucket whether an odd number of the set's shingles falls there. Two sketches differ in no more
bits than the sets do in shingles, so who differs in too many is not similar, and no link is lost. A sketch that grows
with its set stays telling for long texts; halves laid on one another by exclusive or make that of half the buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bits of a sketch, or the least that one has.
SKETCH = 1024


def parities(codes: np.ndarray, bits: int = SKETCH) -> bytes:
    """Which of so many buckets hold an odd number of the shingles."""
    odd = np.bincount((codes[:, 1] % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def growing_parities(codes: np.ndarray) -> bytes:
    """Two buckets and more for each shingle, a power of two."""
    return parities(codes, max(SKETCH, 1 << (2 * len(codes) - 1).bit_length()) if len(codes) else SKETCH)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the sketches, row by row, differ: in as many shingles at least the sets do."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of so many bytes, a power of two, that the same set has."""
    words = np.frombuffer(sketch, np.uint64)
    while 8 * len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def close_sketches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Those pairs (a, b) that the sizes sa, sb of their sets and the sketches x, y allow to be similar."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            x, y = (part.column(c).to_pylist() for c in ("x", "y"))
            sizes = sum(part.column(c).to_numpy(zero_copy_only=False) for c in ("sa", "sb"))
            width = np.array([min(len(p), len(q)) for p, q in zip(x, y)])
            apart = np.zeros(len(width), np.int64)
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                apart[rows] = differing(*(np.stack([folded(z[k], w) for k in rows]) for z in (x, y)))
            ok = (1 + similarity) * apart <= (1 - similarity) * sizes + 1e-6
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
