"""Tall-and-skinny QR, thin QR and least squares."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix, TallMatrix
from tallmat.operators import batches as codec
from tallmat.operators.fold import fold, parts_to_numpy, ship
from tallmat.operators.products import map_blocks, paired_rows
from tallmat.session import MAX_DIRECT_COLS

RANK_TOL = 1e-12
# From this width on, factoring two stacked R takes longer than a shuffle.
COSTLY_COLS = 512


@dataclass
class TsqrResult:
    """R with a non-negative diagonal, the column L1 norms, and the number of rows."""

    r: np.ndarray
    col_l1: np.ndarray
    n_rows: int


def _stack(top: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    x = x if top is None else np.vstack([top, x])
    # a stack shorter than its width passes through unfactored
    return x if x.shape[0] <= x.shape[1] else np.linalg.qr(x, mode="r")


def tsqr(a: TallMatrix | CooMatrix) -> TsqrResult:
    """R of A = QR and the column L1 norms, in one pass.

    A partial is the R of its rows below two header rows: column norms and row count.
    """
    return _tsqr(*a.blocks(), a.n_cols)


def _tsqr(df, read, n: int) -> TsqrResult:
    if n > MAX_DIRECT_COLS:
        raise ValueError(f"{n} columns are too many for one R factor (limit {MAX_DIRECT_COLS}); use panels.panel_qr")
    # short batches are stacked first, so that a wide R is not re-factored for a few rows
    least = 2 * n

    def local(batches):
        r, pending, height = None, [], 0
        header = np.zeros((2, n))
        blocks = (x for batch in batches for _, x in read(batch) if len(x))
        for x in blocks:
            header[0] += np.abs(x).sum(axis=0)
            header[1, 0] += x.shape[0]
            pending.append(x)
            height += x.shape[0]
            if height >= least:
                r, pending, height = _stack(r, np.vstack(pending)), [], 0
        if pending:
            r = _stack(r, np.vstack(pending))
        if r is not None:
            yield 0, np.vstack([header, r])

    def merge(p, q):
        return np.vstack([p[:2] + q[:2], _stack(p[2:], q[2:])])

    parts = fold(df, local, merge, costly=n >= COSTLY_COLS)
    merged = parts_to_numpy(parts, n + 2, n)
    r = np.linalg.qr(merged[2:], mode="r")
    signs = np.where(np.diag(r) < 0, -1.0, 1.0)
    r = r * signs[: r.shape[0], None]
    return TsqrResult(np.triu(r), merged[0], int(merged[1, 0]))


def has_full_rank(r: np.ndarray) -> bool:
    s = np.linalg.svd(r, compute_uv=False)
    return r.shape[0] == r.shape[1] and s[-1] > RANK_TOL * s[0]


def thin_qr(a: TallMatrix) -> tuple[TallMatrix, np.ndarray | TallMatrix]:
    """Q (a table) and R with A = QR; a second round makes Q orthonormal to rounding.

    A must have full column rank. Above MAX_DIRECT_COLS columns R is a table too.
    """
    if a.n_cols > MAX_DIRECT_COLS:
        from tallmat.operators import panels

        return panels.thin_qr(a)
    spark = a.df.sparkSession
    r1 = tsqr(a).r
    if not has_full_rank(r1):
        raise ValueError("thin QR needs a matrix of full column rank")
    first = ship(spark, np.linalg.inv(r1))
    once = map_blocks(a, lambda x: x @ first())
    r2 = tsqr(once).r
    second = ship(spark, np.linalg.inv(r2))
    return map_blocks(a, lambda x: (x @ first()) @ second()), r2 @ r1


@dataclass
class LeastSquaresFit:
    """Solutions as an (n, q) array and the residual norm of each right-hand side."""

    x: np.ndarray
    residual: np.ndarray


def _reduced_system(a: TallMatrix, b: TallMatrix | int):
    """R and Q'b from one TSQR of [A | b]; the rest of the factor holds the residuals.

    An integer b says how many trailing columns of `a` are the right-hand sides, which
    needs no join.
    """
    if isinstance(b, int):
        n, q = a.n_cols - b, b
        r = tsqr(a).r
    else:
        n, q = a.n_cols, b.n_cols

        def read(batch):
            left = codec.dense_block(batch.column("a"), n)
            x = np.hstack([left, codec.dense_block(batch.column("b"), q)])
            yield batch.column("row_id"), x

        r = _tsqr(paired_rows(a, b), read, n + q).r
    square = np.zeros((n + q, n + q))
    square[: r.shape[0]] = r
    return square[:n, :n], square[:n, n:], square[n:, n:]


def _wide_system(a: TallMatrix, b: TallMatrix | int) -> tuple[TallMatrix, int] | None:
    """[A | b] and the columns of b, where one R of them is too large."""
    q = b if isinstance(b, int) else b.n_cols
    n = a.n_cols + (0 if isinstance(b, int) else q)
    if n <= MAX_DIRECT_COLS:
        return None
    if isinstance(b, int):
        return a, q
    return TallMatrix(paired_rows(a, b).select("row_id", F.concat("a", "b").alias("v")), n), q


def least_squares(a: TallMatrix, b: TallMatrix | int) -> LeastSquaresFit:
    """argmin ||A x - b|| for every column of b, or for the last b columns of a."""
    if wide := _wide_system(a, b):
        from tallmat.operators import panels

        return LeastSquaresFit(*panels.least_squares(*wide))
    r, qtb, rest = _reduced_system(a, b)
    if not has_full_rank(r):
        raise ValueError("least squares needs a matrix of full column rank; use ridge")
    return LeastSquaresFit(np.linalg.solve(r, qtb), np.linalg.norm(rest, axis=0))


def ridge(a: TallMatrix, b: TallMatrix | int, lambdas: Sequence[float]) -> list[np.ndarray]:
    """argmin ||A x - b||^2 + lambda ||x||^2 for every lambda, all from one pass."""
    if any(lam < 0 for lam in lambdas):
        raise ValueError("lambda must not be negative")
    if wide := _wide_system(a, b):
        from tallmat.operators import panels

        return panels.ridge(*wide, lambdas)
    r, qtb, _ = _reduced_system(a, b)
    n = r.shape[0]
    solutions = []
    for lam in lambdas:
        stacked = np.vstack([r, np.sqrt(lam) * np.eye(n)])
        target = np.vstack([qtb, np.zeros_like(qtb)])
        solutions.append(np.linalg.lstsq(stacked, target, rcond=None)[0])
    return solutions
