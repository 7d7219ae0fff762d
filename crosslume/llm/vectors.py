"""Vectors of whole numbers, out of the list columns of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCALE = 256
LARGEST = 1 << 26  # components beyond this could leave 64 bits when products of them are added up


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors (not null, nothing null, infinite or NaN in them), and the length of every row."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = bad[offsets[1:]] == bad[offsets[:-1]]
    return good & np.asarray(column.is_valid()), np.diff(offsets)


def whole(column: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    """floor(SCALE * x) of these rows, all of one length; an error if a component is beyond LARGEST."""
    starts = np.asarray(column.offsets).astype(np.int64)[rows]
    values = column.values.to_numpy(zero_copy_only=False)
    picked = values[starts[:, None] + np.arange(length)].astype(np.float64).reshape(len(rows), length)
    scaled = np.floor(SCALE * picked)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a vector has a component beyond {LARGEST // SCALE}: scores may leave 64 bits")
    return scaled.astype(np.int32)


def exact_type(length: int, *largest: float) -> type:
    """The cheapest type in which sums of ``length`` products of numbers up to these are exact."""
    most = float(max(length, 1)) * float(np.prod([max(x, 1) for x in largest]))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0
