"""Reading of embedding columns into packed matrices, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute


def matrix(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(usable, rows): which vectors are complete (not null, not empty, all components finite), and these as doubles."""
    usable, rows = np.zeros(len(column), bool), []
    flat, offsets = column.flatten(), None
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    lengths = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    for i in range(len(column)):
        row = values[offsets[i] : offsets[i + 1]]
        if len(row) and np.isfinite(row).all():
            usable[i] = True
            rows.append(row)
    return usable, rows
