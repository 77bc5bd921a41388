"""Matrices of the tests as plain numpy arrays."""

import numpy as np


def dense(a, shape):
    """A (row_id, v) or (row_id, col_id, val) matrix as numpy, absent entries 0."""
    df = a.entries() if hasattr(a, "entries") else a.df
    x = np.zeros(shape)
    for r in df.collect():
        x[r.row_id, r.col_id] = r.val
    return x
