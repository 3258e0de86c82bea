"""Integer vectors inside tasks: exact whatever their size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa


def stack(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of length `dims` as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)


def integers(values: np.ndarray, scale: int, limit: float) -> np.ndarray:
    """floor(scale * x) of finite numbers: as floats where none is beyond `limit`, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * values)
    if np.abs(scaled).max(initial=0) <= limit:
        return scaled
    whole = [math.floor(s) if math.isfinite(s) else int(x) * scale for x, s in zip(values.ravel().tolist(), scaled.ravel().tolist())]
    return np.array(whole, object).reshape(values.shape)


def whole(values: np.ndarray) -> np.ndarray:
    """The same numbers as Python's integers."""
    if values.dtype == object:
        return values
    return np.array([int(x) for x in values.ravel().tolist()], object).reshape(values.shape)


def rough(values: np.ndarray) -> np.ndarray:
    """The numbers in floating point, the largest cut off."""
    if values.dtype != object:
        return values
    most = 10**150
    return np.array([float(max(-most, min(most, x))) for x in values.ravel().tolist()]).reshape(values.shape)
