"""Matrix products that scan the rows once and add up a small matrix.

The right-hand side of these products is a local matrix of checked size. Wider
problems go through `tallmat.operators.joined`, where it is a table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.frames import ROW_SCHEMA, CooMatrix, TallMatrix
from tallmat.operators import batches as codec
from tallmat.operators.fold import MatrixSum, Shipped, ship
from tallmat.session import MAX_DIRECT_COLS


def map_blocks(tall: TallMatrix, f: Callable, n_out: int | None = None) -> TallMatrix:
    """Apply a numpy function to every block of rows: (rows, n) -> (rows, n_out)."""
    n_out = n_out or tall.n_cols
    df, read = tall.blocks()

    def run(batches):
        for batch in batches:
            for row_ids, x in read(batch):
                y = np.asarray(f(x), dtype=np.float64)
                if y.shape != (len(row_ids), n_out):
                    raise ValueError(f"block function returned shape {y.shape}")
                yield codec.rows_batch(row_ids, y)

    return TallMatrix(df.mapInArrow(run, ROW_SCHEMA), n_out)


def times(a: TallMatrix | CooMatrix, b: np.ndarray) -> TallMatrix:
    """A B with B local (n x k); the result has A's rows and stays distributed."""
    _check_inner(a.n_cols, b.shape[0])
    if not isinstance(a, (TallMatrix, CooMatrix)):
        return a.times_local(b)
    n, k = b.shape
    get = ship(a.df.sparkSession, b)
    if isinstance(a, TallMatrix):
        return map_blocks(a, lambda x: x @ get(), k)

    def run(batches):
        rhs = get()
        for piece in (p for batch in batches for p in codec.pieces(batch, k)):
            rows, cols, vals = codec.sparse_block(piece)
            y = codec.row_sums(rows, cols, vals, rhs, piece.num_rows)
            yield codec.rows_batch(piece.column("row_id"), y)

    return TallMatrix(a.sparse_rows().mapInArrow(run, ROW_SCHEMA), k)


def _gram_times_sum(a: TallMatrix | CooMatrix, b: np.ndarray, get: Shipped) -> MatrixSum:
    _check_inner(a.n_cols, b.shape[0])
    n, k = b.shape

    def dense(batches):
        acc, rhs = None, get()
        for batch in batches:
            for _, x in read(batch):
                y = x.T @ (x @ rhs)
                acc = y if acc is None else np.add(acc, y, out=acc)
        return acc

    def sparse(batches):
        acc, rhs = None, get()
        for piece in (p for batch in batches for p in codec.pieces(batch, k)):
            rows, cols, vals = codec.sparse_block(piece)
            y = codec.row_sums(rows, cols, vals, rhs, piece.num_rows)
            acc = np.zeros((n, k)) if acc is None else acc
            codec.add_outer(acc, rows, cols, vals, y)
        return acc

    if isinstance(a, TallMatrix):
        df, read = a.blocks()
        return MatrixSum(df, dense, n, k)
    return MatrixSum(a.sparse_rows(), sparse, n, k)


def gram_times(a: TallMatrix | CooMatrix, b: np.ndarray) -> TallMatrix:
    """A'A B as an n x k table."""
    shipped = ship(a.df.sparkSession, b)
    return TallMatrix(_gram_times_sum(a, b, shipped).to_rows(), b.shape[1])


def gram_times_local(a: TallMatrix | CooMatrix, b: np.ndarray) -> np.ndarray:
    """A'A B brought to the driver, for iterations that go on from it."""
    if not isinstance(a, (TallMatrix, CooMatrix)):
        return a.gram_times_local(b)
    shipped = ship(a.df.sparkSession, b)
    try:
        return _gram_times_sum(a, b, shipped).to_numpy()
    finally:
        shipped.release()


def covariance_times(a: TallMatrix | CooMatrix, b: np.ndarray, n_rows: int) -> TallMatrix:
    """(1/m) A'A B."""
    return gram_times(a, b) * (1.0 / n_rows)


def _gram_sum(a: TallMatrix | CooMatrix) -> MatrixSum:
    n = a.n_cols
    if n > MAX_DIRECT_COLS:
        raise ValueError(f"the whole Gram matrix of {n} columns is not formed; use gram_times")
    return _gram_columns_sum(a, 0, n)


def _gram_columns_sum(a: TallMatrix | CooMatrix, start: int, stop: int) -> MatrixSum:
    df, read = a.blocks()

    def local(batches):
        acc = None
        for batch in batches:
            for _, x in read(batch):
                g = x.T @ x[:, start:stop]
                acc = g if acc is None else np.add(acc, g, out=acc)
        return acc

    return MatrixSum(df, local, a.n_cols, stop - start)


def gram(a: TallMatrix | CooMatrix) -> TallMatrix | CooMatrix:
    """A'A as an n x n table; of a sparse matrix above MAX_DIRECT_COLS columns, its entries."""
    if a.n_cols > MAX_DIRECT_COLS and isinstance(a, TallMatrix):
        from tallmat.operators.blocked import BlockedMatrix

        return BlockedMatrix.from_tall(a).gram()
    if a.n_cols > MAX_DIRECT_COLS and isinstance(a, CooMatrix):
        from tallmat.operators.pairs import gram_entries

        return gram_entries(a)
    return TallMatrix(_gram_sum(a).to_rows(), a.n_cols)


def gram_columns(a: TallMatrix | CooMatrix, start: int, stop: int) -> TallMatrix:
    """Columns [start, stop) of A'A as a table of n rows."""
    return TallMatrix(_gram_columns_sum(a, start, stop).to_rows(), stop - start)


def gram_local(a: TallMatrix | CooMatrix) -> np.ndarray:
    return _gram_sum(a).to_numpy()


def transpose_times(a: TallMatrix, b: TallMatrix) -> TallMatrix:
    """A'B for two tables over the same row ids, as an n x k table."""
    n, k = a.n_cols, b.n_cols

    def local(batches):
        acc = None
        for batch in batches:
            y = codec.dense_block(batch.column("a"), n).T @ codec.dense_block(batch.column("b"), k)
            acc = y if acc is None else np.add(acc, y, out=acc)
        return acc

    paired = paired_rows(a, b)
    return TallMatrix(MatrixSum(paired, local, n, k).to_rows(), k)


def paired_rows(a: TallMatrix, b: TallMatrix) -> DataFrame:
    """(row_id, a[], b[]); a row id missing on one side raises."""
    left = a.df.withColumnRenamed("v", "a")
    both = left.join(b.df.withColumnRenamed("v", "b"), "row_id", "full_outer")
    unmatched = F.col("a").isNull() | F.col("b").isNull()
    failure = F.raise_error("row ids of the two matrices differ").cast("array<double>")
    return both.select("row_id", F.when(unmatched, failure).otherwise(F.col("a")).alias("a"), "b")


def left_times(b_transposed: TallMatrix, a: TallMatrix) -> TallMatrix:
    """B A for a short, very wide B stored as its transpose (row_id, v[l]): an l x n table."""
    return transpose_times(b_transposed, a)


def residual_correlation(g: np.ndarray, chosen: list[int], h: np.ndarray) -> np.ndarray:
    """(A - A_K H)'A from the Gram matrix G = A'A alone."""
    return g - h.T @ g[chosen, :]


def local_rows(spark, x: np.ndarray, first_row: int = 0) -> TallMatrix:
    """A small local matrix as a table with row ids counting from `first_row`."""
    from tallmat.operators.fold import check_local

    check_local(*x.shape)
    ids = pa.array(np.arange(first_row, first_row + x.shape[0], dtype=np.int64))
    table = pa.Table.from_batches([codec.rows_batch(ids, np.asarray(x, dtype=np.float64))])
    return TallMatrix(spark.createDataFrame(table), x.shape[1])


def _check_inner(n: int, rows: int) -> None:
    if n != rows:
        raise ValueError(f"{n} columns against {rows} rows")
