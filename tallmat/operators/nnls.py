"""Non-negative least squares for many right-hand sides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallmat.frames import TallMatrix
from tallmat.operators import batches as codec
from tallmat.operators.fold import ship

DUAL_TOL = 1e-12
# a gradient above this share of the largest one is no rounding error
OPEN_TOL = 1e-8
# weights up to this value count as 0
ZERO_WEIGHT = 1e-20


def _solve_free(g: np.ndarray, b: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Unconstrained minimizer over the free unknowns of each row, 0 elsewhere."""
    z = np.zeros_like(b)
    masks, group = np.unique(free, axis=0, return_inverse=True)
    for i, mask in enumerate(masks):
        rows = np.flatnonzero(group.ravel() == i)
        sub, rhs = g[np.ix_(mask, mask)], b[np.ix_(rows, mask)].T
        try:
            part = np.linalg.solve(sub, rhs)
        except np.linalg.LinAlgError:
            part = np.linalg.lstsq(sub, rhs, rcond=None)[0]
        z[np.ix_(rows, mask)] = part.T
    return z


def solve_nnls(g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimize h'Gh/2 - b_i'h over h >= 0 for every row b_i; also flags convergence.

    Active set on the normal equations; all rows advance together and rows with the
    same free set share one factorization.
    """
    count, p = b.shape
    x, free = np.zeros((count, p)), np.zeros((count, p), dtype=bool)
    limit = DUAL_TOL * np.abs(b).max(axis=1, initial=0.0)
    live = np.arange(count)
    for _ in range(3 * p if p < 3 else p * p):
        dual = np.where(free[live], -np.inf, b[live] - x[live] @ g)
        best = dual.argmax(axis=1)
        rising = dual[np.arange(len(live)), best] > limit[live]
        live, best = live[rising], best[rising]
        if live.size == 0:
            break
        free[live, best] = True
        todo = live
        while todo.size:
            z = _solve_free(g, b[todo], free[todo])
            blocked = free[todo] & (z <= 0)
            stuck = blocked.any(axis=1)
            x[todo[~stuck]] = z[~stuck]
            todo, z, blocked = todo[stuck], z[stuck], blocked[stuck]
            if todo.size:
                # move to the first bound on the way to z and fix those unknowns at 0
                gap = np.where(blocked, x[todo] - z, 1.0)
                step = np.where(blocked, x[todo] / gap, np.inf)
                alpha = step.min(axis=1, keepdims=True)
                x[todo] += alpha * (z - x[todo])
                free[todo] &= ~(blocked & (step <= alpha))
                x[todo] = np.where(free[todo], np.maximum(x[todo], 0.0), 0.0)
    dual = np.where(free, -np.inf, b - x @ g)
    return x, dual.max(axis=1, initial=-np.inf) <= limit


def solved(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """solve_nnls, which must have come to an end: raises where a gradient still points inward."""
    x, done = solve_nnls(g, b)
    if not done.all():
        dual = np.where(x > 0, -np.inf, b - x @ g).max(axis=1, initial=-np.inf)
        if (dual > OPEN_TOL * np.abs(b).max(axis=1, initial=0.0)).any():
            raise RuntimeError("non-negative least squares did not converge")
    return x


def nnls_rows(
    targets: TallMatrix,
    basis: np.ndarray,
    weights: np.ndarray | None = None,
    weights_are_roots: bool = False,
) -> DataFrame:
    """(row_id, h[p], converged): argmin ||basis' h - row|| over h >= 0 for every row.

    `basis` has one row per unknown. `weights` scale the equations, that is the
    columns of both: by their square roots, or directly when they are roots already.
    """
    n, (p, width) = targets.n_cols, basis.shape
    if width != n:
        raise ValueError(f"basis vectors have {width} values, rows have {n}")
    scaled = basis
    if weights is not None:
        weights = np.asarray(weights, dtype=np.float64)
        if weights.shape != (n,):
            raise ValueError(f"{weights.shape} weights for {n} equations")
        squares = weights**2 if weights_are_roots else np.where(weights > ZERO_WEIGHT, weights, 0.0)
        scaled = basis * squares
    gram = scaled @ basis.T
    get = ship(targets.df.sparkSession, scaled.T)

    df, read = targets.blocks()

    def run(batches):
        for batch in batches:
            for row_ids, x in read(batch):
                h, ok = solve_nnls(gram, x @ get())
                columns = [row_ids, codec.list_column(h), pa.array(ok)]
                yield pa.RecordBatch.from_arrays(columns, names=["row_id", "h", "converged"])

    return df.mapInArrow(run, "row_id BIGINT, h ARRAY<DOUBLE>, converged BOOLEAN")
