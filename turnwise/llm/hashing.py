"""Prefix polynomial hashes over byte buffers, vectorised; helpers for batches. Arithmetic is modulo 2^64, where an odd base has an inverse."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
U64 = np.uint64


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(n, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Prefix:
    """Prefix hashes of a buffer of pieces; `rel` is each byte's offset in its piece."""

    def __init__(self, buf: np.ndarray, rel: np.ndarray, powers: Powers):
        powers.reach(int(rel.max()) + 1 if len(rel) else 1)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * powers.up[rel], out=self.sums[1:])
        self.rel, self.down = rel, powers.down

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), alike for equal bytes wherever they stand."""
        return (self.sums[end] - self.sums[start]) * self.down[self.rel[start]]


def ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated ranges starts[i] .. starts[i] + counts[i] - 1, and the i of each element."""
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[owner] + within, owner


def parts_of(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of at most 512 rows whose texts hold about `most` bytes, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        end = int(np.searchsorted(size, (size[low - 1] if low else 0) + most, side="right"))
        end = min(max(end, low + 1), low + 512)
        yield batch.slice(low, end - low)
        low = end
