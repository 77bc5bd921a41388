"""Centered, scaled sparse matrices as an algebra: D (A - m 1') is applied, never formed.

m holds the row means and D what standardizing or weighting multiplies a row by. Products need A's stored entries and one
small correction: (A - m 1') B = A B - m (1'B), and (A - m 1')'Y = A'Y - 1 (m'Y).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.frames import ROW_SCHEMA, CooMatrix, TallMatrix
from tallmat.functions import arrays
from tallmat.operators import batches as codec
from tallmat.operators.fold import MatrixSum, ship
from tallmat.operators.joined import JoinedMatrix
from tallmat.operators.preprocess import METHODS, required
from tallmat.operators.stats import row_mean_std
from tallmat.session import is_kept, keep


class CenteredSparse:
    """`rows(row_id, idx[], val[], m, d)` stands for the rows d (a - m); rows without entries are zero and absent."""

    def __init__(self, rows: DataFrame, n_cols: int, entries: DataFrame):
        self.rows, self.n_cols, self.entries = rows, n_cols, entries
        self._callers = False

    @property
    def df(self) -> DataFrame:
        return self.rows

    def keep(self) -> CenteredSparse:
        kept = CenteredSparse(keep(self.rows), self.n_cols, self.entries)
        kept._callers = is_kept(self.rows)
        return kept

    def release(self) -> None:
        if not self._callers:
            self.rows.unpersist()

    def blocks(self):
        """As TallMatrix.blocks: rows made dense inside the task, a bounded block at a time."""
        n = self.n_cols

        def read(batch):
            start = 0
            for row_ids, x in codec.scatter_blocks(batch, n):
                m, d = (batch.column(c).to_numpy()[start : start + len(x), None] for c in ("m", "d"))
                start += len(x)
                yield row_ids, (x - m) * d

        return self.rows, read

    def squared_norm(self) -> DataFrame:
        """One record `val`: the sum of squares, those of the filled zeros included."""
        around = F.aggregate("val", F.lit(0.0), lambda acc, x: acc + (x - F.col("m")) * (x - F.col("m")))
        rest = (self.n_cols - F.size("val")) * F.col("m") * F.col("m")
        return self.rows.agg(F.sum((around + rest) * F.col("d") * F.col("d")).alias("val"))

    def times_local(self, b: np.ndarray) -> TallMatrix:
        """The product with a local n x k matrix, with the matrix's rows."""
        get = ship(self.rows.sparkSession, b)

        def run(batches):
            rhs = get()
            ones = rhs.sum(axis=0)
            for piece in (p for batch in batches for p in codec.pieces(batch, rhs.shape[1])):
                yield codec.rows_batch(piece.column("row_id"), _times(piece, rhs, ones))

        return TallMatrix(self.rows.mapInArrow(run, ROW_SCHEMA), b.shape[1])

    def gram_times_local(self, b: np.ndarray) -> np.ndarray:
        n, k = b.shape
        get = ship(self.rows.sparkSession, b)

        def local(batches):
            acc, rhs = None, get()
            ones, correction = rhs.sum(axis=0), np.zeros(k)
            for piece in (p for batch in batches for p in codec.pieces(batch, k)):
                rows, cols, vals = codec.sparse_block(piece)
                y = _times(piece, rhs, ones) * piece.column("d").to_numpy()[:, None]
                acc = np.zeros((n, k)) if acc is None else acc
                codec.add_outer(acc, rows, cols, vals, y)
                correction += piece.column("m").to_numpy() @ y
            return None if acc is None else acc - correction

        try:
            return MatrixSum(self.rows, local, n, k).to_numpy()
        finally:
            get.release()

    def placed(self) -> CenteredJoined:
        return CenteredJoined(self)


def _times(piece, rhs: np.ndarray, ones: np.ndarray) -> np.ndarray:
    rows, cols, vals = codec.sparse_block(piece)
    m, d = (piece.column(c).to_numpy()[:, None] for c in ("m", "d"))
    return (codec.row_sums(rows, cols, vals, rhs, piece.num_rows) - m * ones) * d


class CenteredJoined:
    """The same products where the other factor is a table: joins of A's entries and two small corrections."""

    def __init__(self, a: CenteredSparse):
        self.n_cols = a.n_cols
        self._stats = keep(a.rows.select("row_id", "m", "d"))
        self._joined = JoinedMatrix(CooMatrix(a.entries, a.n_cols, canonical=True))

    def _with_stats(self, y: TallMatrix) -> DataFrame:
        return y.df.join(self._stats, "row_id")

    def times(self, b: TallMatrix) -> TallMatrix:
        ones = _column_sums(b.df, b.n_cols, lambda x: x)
        shift = F.lit([float(x) for x in ones])
        product = self._with_stats(self._joined.times(b))
        v = F.zip_with("v", F.transform(shift, lambda c: c * F.col("m")), lambda x, c: (x - c) * F.col("d"))
        return TallMatrix(product.select("row_id", v.alias("v")), b.n_cols)

    def transpose_times(self, b: TallMatrix) -> TallMatrix:
        scaled = self._with_stats(b).select("row_id", "m", F.transform("v", lambda x: x * F.col("d")).alias("v"))
        correction = F.lit([float(x) for x in _column_sums(scaled, b.n_cols, lambda x: x * F.col("m"))])
        product = self._joined.transpose_times(TallMatrix(scaled, b.n_cols))
        # every column has the correction, with entries or without
        zeros = F.array_repeat(F.lit(0.0), b.n_cols)
        rows = self.column_ids().join(product.df, "row_id", "left").select("row_id", F.coalesce("v", zeros).alias("v"))
        return TallMatrix(rows.select("row_id", F.zip_with("v", correction, lambda x, c: x - c).alias("v")), b.n_cols)

    def gram_times(self, b: TallMatrix) -> TallMatrix:
        y = self.times(b)
        kept = TallMatrix(keep(y.df), y.n_cols)
        return self.transpose_times(kept)

    def column_ids(self) -> DataFrame:
        return self._stats.sparkSession.range(self.n_cols).withColumnRenamed("id", "row_id")

    def release(self) -> None:
        self._joined.release()
        self._stats.unpersist()


def _column_sums(df: DataFrame, k: int, f) -> list[float]:
    """k numbers."""
    sums = df.agg(*[F.sum(f(F.col("v")[j])).alias(f"s{j}") for j in range(k)]).first()
    return [x or 0.0 for x in sums]


def prepare_sparse(
    a: CooMatrix, method: str, weights: DataFrame | None = None
) -> tuple[CooMatrix | CenteredSparse, DataFrame]:
    """As preprocess.preprocess for a sparse matrix, whose zeros are never filled in."""
    if method not in METHODS:
        raise ValueError(f"unknown preprocessing {method!r}; one of {', '.join(METHODS)}")
    weighted = method.startswith("cosLat+")
    if weighted and weights is None:
        raise ValueError(f"{method} needs weights(row_id, weight)")
    stats = row_mean_std(a)
    if weighted:
        stats = stats.join(weights.select("row_id", "weight"), "row_id", "left")
        stats = stats.withColumn("weight", required(F.col("weight"), "no weight for row "))
    else:
        stats = stats.withColumn("weight", F.lit(1.0))
    row_stats = stats.select(
        "row_id", "mean", "std", "weight", (F.col("mean") * F.col("weight")).alias("weighted_mean"), "low_std"
    )
    if method == "none":
        return a, row_stats
    rows = a.sparse_rows()
    mean = arrays.total(F.col("val")) / a.n_cols
    if method == "standardizeEach":
        scale = row_stats.select("row_id", (1.0 / F.col("std")).alias("d"))
        rows = rows.join(scale, "row_id")
    elif weighted:
        rows = rows.join(weights.select("row_id", "weight"), "row_id", "left")
        rows = rows.withColumn("d", required(F.col("weight"), "no weight for row ")).drop("weight")
    else:
        rows = rows.withColumn("d", F.lit(1.0))
    rows = rows.select("row_id", "idx", "val", mean.alias("m"), "d")
    return CenteredSparse(rows, a.n_cols, a.df), row_stats
