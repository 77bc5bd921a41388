"""Near-separable non-negative factorization A ~ A[:, K] H by column selection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.frames import ROW_SCHEMA, CooMatrix, TallMatrix
from tallmat.operators import batches as codec
from tallmat.operators import stats
from tallmat.operators.blocked import BlockedMatrix
from tallmat.operators.fold import MatrixSum, Shipped, check_local, ship
from tallmat.operators.nnls import solved
from tallmat.operators.preprocess import non_negative, unit_l1_factors
from tallmat.operators.products import residual_correlation
from tallmat.operators.tsqr import tsqr
from tallmat.session import MAX_DIRECT_COLS, cut_lineage

SCORES = ("positive_part", "norm")


def select_columns(
    g: np.ndarray, r: int, score: str = "positive_part"
) -> tuple[list[int], np.ndarray]:
    """Extreme columns K of X and H = argmin ||X - X_K H||, H >= 0, from G = X'X.

    Each pick takes the column whose residual correlates most with the data,
    relative to its norm: by the positive part only, or by the plain norm. Ties go
    to the smallest index; zero columns are never picked.
    """
    if score not in SCORES:
        raise ValueError(f"unknown score {score!r}; one of {', '.join(SCORES)}")
    n = g.shape[0]
    norms = np.sqrt(np.diag(g))
    usable = int((norms > 0).sum())
    if not 1 <= r <= usable:
        raise ValueError(f"{r} columns asked for, {usable} of {n} are not zero")
    picks: list[int] = []
    h = np.zeros((0, n))
    for _ in range(r):
        m = residual_correlation(g, picks, h)
        part = np.maximum(m, 0.0) if score == "positive_part" else m
        values = np.full(n, -1.0)
        np.divide(np.linalg.norm(part, axis=0), norms, out=values, where=norms > 0)
        values[picks] = -1.0
        picks.append(int(values.argmax()))
        h = solved(g[np.ix_(picks, picks)], g[picks, :].T).T
    return picks, h


@dataclass
class NmfModel:
    """columns(rank_pos, col_id), w(row_id, v[r]) if asked for, h(comp, col_id, h)."""

    columns: DataFrame
    h: DataFrame
    w: TallMatrix | None
    picks: list[int]
    h_local: np.ndarray | None
    matrix: TallMatrix | None = None

    def relative_error(self) -> DataFrame:
        """One record `val`: ||A - W H|| / ||A||; W is part of A's rows, so no join."""
        h, picks = ship(self.h.sparkSession, self._local_h()), self.picks
        errors = stats.block_error(self.matrix, lambda x: x[:, picks] @ h())
        return errors.select(F.sqrt(F.col("sse") / F.col("ssq")).alias("val"))

    def _local_h(self) -> np.ndarray:
        if self.h_local is None:
            check_local(len(self.picks), self.matrix.n_cols)
            rows = self.h.orderBy("comp", "col_id").toArrow().column("h").to_numpy()
            self.h_local = rows.reshape(len(self.picks), -1)
        return self.h_local

    def save(self, path: str) -> None:
        self.columns.write.parquet(f"{path}/columns")
        self.h.write.parquet(f"{path}/h")
        if self.w is not None:
            self.w.df.write.parquet(f"{path}/w")


def load_nmf(spark: SparkSession, path: str, with_w: bool = True) -> dict[str, DataFrame]:
    parts = ["columns", "h"] + (["w"] if with_w else [])
    return {part: spark.read.parquet(f"{path}/{part}") for part in parts}


def nmf(
    a: TallMatrix | CooMatrix,
    r: int,
    score: str = "positive_part",
    scale_columns: bool = True,
    negatives: str = "keep",
    return_w: bool = True,
    max_direct_cols: int = MAX_DIRECT_COLS,
) -> NmfModel:
    """One pass for R and the column sums, selection on R, and W as a second, lazy pass.

    A matrix of more than `max_direct_cols` columns is selected from its Gram table.
    """
    if isinstance(a, CooMatrix):
        a = a.to_tall()
    a = non_negative(a, negatives)
    if a.n_cols > max_direct_cols:
        return _wide_nmf(a, r, score, scale_columns, return_w)
    factor = tsqr(a)
    down = unit_l1_factors(factor.col_l1) if scale_columns else np.ones(a.n_cols)
    x = factor.r * down
    picks, h = select_columns(x.T @ x, r, score)
    # back to the scale of A, whose columns K make up W
    up = np.divide(1.0, down, out=np.zeros_like(down), where=down > 0)
    h = h * up / up[picks][:, None]
    spark = a.df.sparkSession
    columns = spark.createDataFrame(list(enumerate(picks)), "rank_pos BIGINT, col_id BIGINT")
    w = a.gather(picks) if return_w else None
    return NmfModel(columns, _long(spark, h), w, picks, h, a)


def gram_table(a: TallMatrix) -> TallMatrix:
    """A'A as n rows of n values, from one pass over tiles."""
    tiles = BlockedMatrix.from_tall(a)
    table = TallMatrix(cut_lineage(tiles.gram().df), a.n_cols)
    tiles.release()
    return table


def _wide_nmf(a: TallMatrix, r: int, score: str, scale_columns: bool, return_w: bool) -> NmfModel:
    """The selection with G = A'A as a table: one pass over G for each pick.

    Row i of G gives the coefficients of column i and its residual correlations at
    once; only the picked rows and one score per column reach the driver.
    """
    if score not in SCORES:
        raise ValueError(f"unknown score {score!r}; one of {', '.join(SCORES)}")
    n, spark = a.n_cols, a.df.sparkSession
    sums = stats.col_norms_l1(a).orderBy("col_id").toArrow().column("val").to_numpy()
    down = unit_l1_factors(sums) if scale_columns else np.ones(n)
    g = gram_table(a)
    picks, gk, norms = [], np.zeros((0, n)), None
    for _ in range(r):
        shipped = ship(spark, np.vstack([down, gk]))
        scores = MatrixSum(g.df, _score_rows(n, picks, shipped, score), n, 2)
        squares, diagonal = scores.to_numpy().T
        shipped.release()
        norms = np.sqrt(diagonal)
        if (norms > 0).sum() < r:
            raise ValueError(f"{r} columns asked for, {(norms > 0).sum()} of {n} are not zero")
        values = np.full(n, -1.0)
        np.divide(np.sqrt(squares), norms, out=values, where=norms > 0)
        values[picks] = -1.0
        best = int(values.argmax())
        row = g.df.where(F.col("row_id") == best).first()["v"]
        picks.append(best)
        gk = np.vstack([gk, np.array(row) * down * down[best]])
    up = np.divide(1.0, down, out=np.zeros_like(down), where=down > 0)
    factor_rows = _coefficient_rows(g, picks, ship(spark, np.vstack([down, up, gk])))
    h = factor_rows.select(
        F.col("pos").cast("bigint").alias("comp"), F.col("row_id").alias("col_id"), "h"
    )
    columns = spark.createDataFrame(list(enumerate(picks)), "rank_pos BIGINT, col_id BIGINT")
    return NmfModel(columns, h, a.gather(picks) if return_w else None, picks, None, a)


def _score_rows(n: int, picks: list[int], shipped: Shipped, score: str):
    """Per task: squared residual correlations of every column, and the diagonal of G."""

    def local(batches):
        acc = None
        down, gk = shipped()[0], shipped()[1:]
        for batch in batches:
            ids = batch.column("row_id").to_numpy()
            x = codec.dense_block(batch.column("v"), n) * down * down[ids][:, None]
            acc = np.zeros((n, 2)) if acc is None else acc
            acc[ids, 1] = x[np.arange(len(ids)), ids]
            if picks:
                x = x - solved(gk[:, picks], x[:, picks]) @ gk
            part = np.maximum(x, 0.0) if score == "positive_part" else x
            acc[:, 0] += (part * part).sum(axis=0)
        return acc

    return local


def _coefficient_rows(g: TallMatrix, picks: list[int], shipped: Shipped) -> DataFrame:
    """(row_id, pos, h): the coefficients of every column, back on A's scale."""
    n = g.n_cols

    def run(batches):
        down, up, gk = shipped()[0], shipped()[1], shipped()[2:]
        for batch in batches:
            ids = batch.column("row_id").to_numpy()
            x = codec.dense_block(batch.column("v"), n)[:, picks]
            h = solved(gk[:, picks], x * down[picks] * down[ids][:, None])
            yield codec.rows_batch(batch.column("row_id"), h * up[ids][:, None] / up[picks])

    rows = g.df.mapInArrow(run, ROW_SCHEMA)
    return rows.select("row_id", F.posexplode("v").alias("pos", "h"))


def _long(spark: SparkSession, h: np.ndarray) -> DataFrame:
    """(comp, col_id, h) for an r x n matrix with n up to MAX_DIRECT_COLS."""
    r, n = h.shape
    table = pa.table(
        {
            "comp": np.repeat(np.arange(r, dtype=np.int64), n),
            "col_id": np.tile(np.arange(n, dtype=np.int64), r),
            "h": np.ascontiguousarray(h).reshape(-1),
        }
    )
    return spark.createDataFrame(table)
