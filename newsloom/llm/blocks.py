"""Sorted 64-bit keys with counts as compressed bytes: what tasks send instead of a row for each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def pack_block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 64-bit keys and counts, byte planes side by side (the upper ones hardly change), compressed."""
    planes = keys.astype("<u8").view(np.uint8).reshape(-1, 8).T
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<u8")
    head = np.array([len(keys), len(large)], dtype="<u8").tobytes()
    return zstandard.compress(head + planes.tobytes() + small.tobytes() + large.tobytes(), 1)


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(block)
    n, m = np.frombuffer(raw, "<u8", 2).astype(int)
    planes = np.frombuffer(raw, np.uint8, 8 * n, 16).reshape(8, n)
    keys = np.ascontiguousarray(planes.T).view("<u8").reshape(-1)
    counts = np.frombuffer(raw, np.uint8, n, 16 + 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", m, 16 + 9 * n).astype(np.int64)
    return keys, counts


def add_up(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sum of their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def merge(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack_block(b) for b in blocks]
    return add_up(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def blocks(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray, kind: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """One block for each shard; ``keys`` ascending."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order]
    ids, first = np.unique(shard, return_index=True)
    for s, a, b in zip(ids.tolist(), first, [*first[1:], len(shard)]):
        yield kind, s, pack_block(keys[a:b], counts[a:b])


BLOCKS = "kind int, shard int, block binary"


def as_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())],
        ["kind", "shard", "block"],
    )
