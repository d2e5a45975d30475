"""Words of Arrow text columns as arrays of 64-bit hashes, without a Python object per word.

Used inside tasks only. Everything works on one Arrow batch at a time and in slices of ``SLICE`` bytes, so memory
follows the batch, not the partition.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time.
SLICE = 1 << 18

_U64 = np.uint64
#: An odd multiplier and its inverse modulo 2**64 (fixed values of the hash).
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (the finaliser of the public splitmix64 generator)."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=_U64) * _U64(_R))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


#: A value for each byte; A-Z count as a-z.
_BYTES = _byte_values()
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, _U64), np.cumprod(np.full(n, base, dtype=_U64))])


@dataclass
class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch: their hashes in order, and where each row's words begin."""

    hashes: np.ndarray
    first: np.ndarray  # one more entry than rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> Words:
    """Cut and hash the words of a batch. A-Z are lower-cased; equal words have equal hashes in every task."""
    raw, offsets = text_buffer(texts)
    inside = _WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(raw))]  # no word reaches over two rows
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    return Words(_hash_spans(raw, start, stop), first)


def _hash_spans(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), dtype=_U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(stop, start[at] + SLICE, side="right")))
            lo, hi = int(start[at]), int(stop[to - 1])
            n = max(SLICE, hi - lo)
            sums = np.empty(hi - lo + 1, dtype=_U64)
            sums[0] = 0
            np.cumsum(_BYTES[raw[lo:hi]] * _powers(n, _R)[: hi - lo], out=sums[1:])
            s, e = start[at:to] - lo, stop[at:to] - lo
            out[at:to] = mix((sums[e] - sums[s]) * _powers(n, _R_INV)[s])
            at = to
    return out


def shingles(w: Words, size: int) -> Words:
    """Hashes of all runs of ``size`` words. A row with fewer words, but one at least, has one shingle of them all."""
    counts = w.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(w.first[:-1], n) + np.arange(first[-1]) - np.repeat(first[:-1], n)
    stop = np.repeat(w.first[1:], n)
    padded = np.concatenate([w.hashes, np.zeros(size, _U64)])
    out = np.zeros(len(at), dtype=_U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            here = padded[at + k]
            here[at + k >= stop] = 0
            out = out * _U64(_R) + here
        return Words(mix(out), first)


def batches_of(texts: pa.Array, most: int = SLICE) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    _, offsets = text_buffer(texts)
    out, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        out.append((at, to))
        at = to
    return out
