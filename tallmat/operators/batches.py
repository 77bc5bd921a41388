"""Arrow record batches to numpy blocks and back, used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Doubles in one block made dense from sparse rows (32 MiB).
DENSE_BLOCK_ELEMS = 1 << 22


def _values(column) -> np.ndarray:
    # integers with a NULL arrive as floats with NaN
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if column.null_count or not np.isfinite(values).all():
        raise ValueError("matrix values must not be NULL, NaN or infinite")
    return values


def dense_block(column, n: int) -> np.ndarray:
    """An array column as a (rows, n) block."""
    values = _values(column)
    if len(values) != len(column) * n or (column.value_lengths().to_numpy() != n).any():
        raise ValueError(f"every row must have {n} values")
    return values.reshape(len(column), n)


def sparse_block(batch):
    """Sparse rows as (local row number per entry, column per entry, value per entry)."""
    idx = batch.column("idx")
    lengths = idx.value_lengths().to_numpy()
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows, idx.flatten().to_numpy(zero_copy_only=False), _values(batch.column("val"))


def pieces(batch, width: int):
    """A batch in slices whose rows times `width` stay bounded."""
    step = max(1, DENSE_BLOCK_ELEMS // width)
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def scatter_blocks(batch, n: int):
    """Sparse rows as dense (row ids, block) pairs of bounded size."""
    for piece in pieces(batch, n):
        rows, cols, vals = sparse_block(piece)
        x = np.zeros((piece.num_rows, n))
        x[rows, cols] = vals
        yield piece.column("row_id"), x


def row_sums(rows, cols, vals, rhs, n_rows: int) -> np.ndarray:
    """Sparse block times rhs, column by column to keep the temporaries small."""
    y = np.empty((n_rows, rhs.shape[1]))
    for j in range(rhs.shape[1]):
        y[:, j] = np.bincount(rows, vals * rhs[cols, j], minlength=n_rows)
    return y


def add_outer(acc: np.ndarray, rows, cols, vals, y: np.ndarray) -> None:
    """Add the transposed sparse block times y to acc, touching only the columns that have entries."""
    if len(cols) == 0:
        return
    order = np.argsort(cols, kind="stable")
    rows, cols, vals = rows[order], cols[order], vals[order]
    begins = np.flatnonzero(np.concatenate([[True], cols[1:] != cols[:-1]]))
    for j in range(y.shape[1]):
        acc[cols[begins], j] += np.add.reduceat(vals * y[rows, j], begins)


def list_column(x: np.ndarray):
    rows, n = x.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int64) * n, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).reshape(-1)))


def rows_batch(row_ids, x: np.ndarray):
    return pa.RecordBatch.from_arrays([row_ids, list_column(x)], names=["row_id", "v"])


def sums_batch(sums: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array(s) for s in sums.T], names=["sse", "ssq"])
