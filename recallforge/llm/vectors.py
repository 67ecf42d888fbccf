"""Access to embedding columns and rows of numbers in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None for a null vector and for one with a null or non-finite component."""
    out: list[np.ndarray | None] = []
    offsets = column.offsets.to_numpy()
    flat = column.values
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64) if len(flat) else np.zeros(0)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values)))) if len(values) else np.zeros(1, np.int64)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    for a, b, ok in zip(offsets[:-1], offsets[1:], there):
        out.append(values[a:b] if ok and bad[b] == bad[a] else None)
    return out


def stacked(raw: list[bytes]) -> np.ndarray:
    """Vectors kept as bytes of little-endian doubles, one below the other; shorter ones end in zeros."""
    got = [np.frombuffer(x, "<f8") for x in raw]
    width = max(map(len, got), default=0)
    if all(len(g) == width for g in got):
        return np.stack(got) if got else np.zeros((0, 0))
    out = np.zeros((len(got), width))
    for r, g in zip(out, got):
        r[: len(g)] = g
    return out
