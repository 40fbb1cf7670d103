"""Fast whole-text primitives for Arrow batches, on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once, so that arrays of 8 bytes a character stay small.
SLICE_BYTES = 4 << 20


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column's values as UTF-8, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def slices(values: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most SLICE_BYTES together, one row at least."""
    start = size = 0
    for i, v in enumerate(values):
        n = len(v) if v else 0
        if i > start and size + n > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(values):
        yield start, len(values)


def byte_sums(values: list[bytes], table: np.ndarray) -> np.ndarray:
    """Per text, the sum over its bytes of ``table[byte]``."""
    ends = np.cumsum([len(v) for v in values], dtype=np.int64)
    data = np.frombuffer(b"".join(values), np.uint8)
    sums = np.zeros(len(values), np.int64)
    starts = np.concatenate(([0], ends[:-1])) if len(values) else ends
    full = np.flatnonzero(ends > starts)
    if len(full):
        sums[full] = np.add.reduceat(table[data], starts[full], dtype=np.int64)
    return sums


def members(chars: bytes) -> np.ndarray:
    """A table for ``byte_sums`` that counts the given bytes."""
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` word hashes."""
    n = len(words) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        if n > 0:
            out = mixed(out + words[j : j + n])
    return out
