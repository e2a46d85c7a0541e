"""Words and five-word shingles of whole texts as 64-bit hashes, vectorised over many documents.

A word's hash is a polynomial of its bytes modulo 2**64, taken as a difference of
prefix sums, so that no word is ever a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = bytes(0x20 if i in (0x20, *range(0x09, 0x0E)) else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))
#: Also turns ASCII punctuation into blanks.
ALPHANUMERIC = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in _FOLD)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; grown as needed, kept for the worker's life."""
    global _powers
    if _powers is None or len(_powers[0]) < size:
        size = max(size, CHUNK_BYTES + 1024)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers = (tables[0], tables[1])
    return _powers


def chunks(bodies: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes (a longer document is a run of its own)."""
    start = 0
    while start < len(bodies):
        end, size = start, 0
        while end < len(bodies) and (end == start or size + len(bodies[end]) <= most):
            size += len(bodies[end]) + 1
            end += 1
        yield start, end
        start = end


def runs_of(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of a text or binary column of about ``most`` bytes (a longer value is a slice of its own).  Nothing is copied:
    what is made of a slice in Python is bounded, whatever the size of the Arrow batch."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start, done = 0, 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield column.slice(start, end - start)
        start, done = end, int(ends[end - 1])


class Words:
    """All words of a run of documents: hashes, and where each document's words begin.

    Bytes A-Z are lower-cased; words are runs of bytes other than blank and 0x09-0x0D,
    unless another folding to blanks is given.
    """

    def __init__(self, bodies: list[bytes], fold: bytes = _FOLD):
        data = np.frombuffer(b" ".join([*bodies, b""]).translate(fold), dtype=np.uint8)
        filled = np.concatenate(([False], data != 0x20, [False]))
        edges = np.flatnonzero(filled[1:] != filled[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        power, inverse = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        self.hashes = mix(raw ^ (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        offsets = np.cumsum([0] + [len(b) + 1 for b in bodies])
        self.bounds = np.searchsorted(self.starts, offsets)  # document d has words bounds[d] to bounds[d+1]
        self.offsets = offsets

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; those that run over a document's end mean nothing."""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.empty(0, dtype=np.uint64)
        total = np.zeros(count, dtype=np.uint64)
        for i in range(n):
            total = total * np.uint64(_BASE) + self.hashes[i : i + count]
        return mix(total ^ np.uint64(n))


def shingle_sets(bodies: list[bytes], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes.  Fewer than n words make one shingle, none make none."""
    for start, end in chunks(bodies):
        words = Words(bodies[start:end])
        grams = words.grams(n)
        for d in range(end - start):
            low, high = int(words.bounds[d]), int(words.bounds[d + 1])
            if high - low >= n:
                yield np.unique(grams[low : high - n + 1])
            elif high > low:
                total = np.zeros(1, dtype=np.uint64)
                for h in words.hashes[low:high]:
                    total = total * np.uint64(_BASE) + h
                yield mix(total ^ np.uint64(high - low))
            else:
                yield np.empty(0, dtype=np.uint64)
