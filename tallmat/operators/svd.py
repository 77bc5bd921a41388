"""Truncated singular value decompositions of tall matrices.

Three regimes, by what has to be held in one process:

* direct: up to MAX_DIRECT_COLS columns, from the R of one TSQR pass;
* local basis: an n x (a few k) basis fits on the driver, one Spark pass per product;
* table basis: the basis is a table too, and products are joins.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix, TallMatrix
from tallmat.functions.noise import normal
from tallmat.operators import products
from tallmat.operators.blocked import BlockedMatrix
from tallmat.operators.fold import fits_locally, ship
from tallmat.operators.joined import JoinedMatrix
from tallmat.operators.packed import PackedSparse
from tallmat.operators.products import local_rows, map_blocks
from tallmat.operators.tsqr import RANK_TOL, tsqr
from tallmat.sources.index import number_rows
from tallmat.session import MAX_BROADCAST_ROWS, MAX_DIRECT_COLS, MAX_LOCAL_ELEMS, cut_lineage, keep

log = logging.getLogger(__name__)

# Residuals relative to the largest Ritz value that rounding leaves.
RESIDUAL_FLOOR = 1e-12
# Blocks in a Krylov basis: so many at least, and up to so many while the basis stays local. A long basis tells close
# singular values apart in fewer passes.
SHORT_BASIS, LONG_BASIS = 6, 64
# A wide matrix with a smaller share of stored entries is passed over by its entries.
SPARSE_SHARE = 1 / 16


@dataclass
class TruncatedSvd:
    """u(row_id, v[k]), s descending, v(row_id = column id, v[k]); A ~ U diag(s) V'."""

    u: TallMatrix
    s: np.ndarray
    v: TallMatrix


def right(x: TallMatrix, m: np.ndarray) -> TallMatrix:
    get = ship(x.df.sparkSession, m)
    return map_blocks(x, lambda block: block @ get(), m.shape[1])


def sign_fix(v: np.ndarray) -> np.ndarray:
    """Signs that make the largest entry (the first on ties) of every column positive."""
    # rounding makes exact ties differ in the last bits
    size = np.round(np.abs(v) / np.abs(v).max(axis=0), 9)
    signs = np.sign(v[size.argmax(axis=0), np.arange(v.shape[1])])
    return np.where(signs == 0, 1.0, signs)


def _kept(s: np.ndarray, k: int) -> int:
    if s.size == 0 or s[0] == 0:
        raise ValueError("the matrix is zero and has no singular vectors")
    rank = int((s > RANK_TOL * s[0]).sum())
    if rank < min(k, s.size):
        log.warning("only %d of %d components are numerically non-zero", rank, k)
    return min(k, rank)


def _check_rank(a, k: int) -> None:
    if not 1 <= k <= a.n_cols:
        raise ValueError(f"rank {k} for a matrix of {a.n_cols} columns")


def _from_local_basis(a, s: np.ndarray, v: np.ndarray, k: int) -> TruncatedSvd:
    kept = _kept(s, k)
    s, v = s[:kept], v[:, :kept]
    v = v * sign_fix(v)
    u = products.times(a, v / s)
    if isinstance(a, BlockedMatrix):
        # the tiles go when the decomposition is done
        u = _saved(u)
    return TruncatedSvd(u, s, local_rows(a.df.sparkSession, v))


def with_rows(x: TallMatrix, ids: DataFrame) -> TallMatrix:
    """The matrix with one row for every id in `ids(row_id)`, zeros where it had none."""
    zeros = F.array_repeat(F.lit(0.0), x.n_cols)
    joined = ids.select("row_id").join(x.df, "row_id", "left")
    return TallMatrix(joined.select("row_id", F.coalesce("v", zeros).alias("v")), x.n_cols)


def all_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row_id")


def _table_signs(v: TallMatrix) -> np.ndarray:
    """sign_fix for a table: the largest size, then one max_by per column."""
    sizes = [F.max(F.abs(F.col("v")[j])).alias(f"c{j}") for j in range(v.n_cols)]
    top = v.df.agg(*sizes).first()
    picks = []
    for j in range(v.n_cols):
        x = F.col("v")[j]
        # larger size first, then the smaller id
        order = F.struct(F.round(F.abs(x) / top[j], 9), -F.col("row_id"))
        picks.append(F.max_by(x, order).alias(f"c{j}"))
    largest = np.array(v.df.agg(*picks).first(), dtype=float)
    return np.where(largest < 0, -1.0, 1.0)


def _from_table_basis(a, joined: JoinedMatrix, s, basis: TallMatrix, rotation, k) -> TruncatedSvd:
    """Rows as in the other regimes: every column of A in V, and in U every row that A has."""
    kept = _kept(s, k)
    s = s[:kept]
    v = right(basis, rotation[:, :kept])
    v = TallMatrix(cut_lineage(right(v, np.diag(_table_signs(v))).df), kept)
    u = joined.times(right(v, np.diag(1.0 / s)))
    if isinstance(a, TallMatrix):
        u = with_rows(u, a.df)
    u = _saved(u)
    return TruncatedSvd(u, s, with_rows(v, all_ids(a.df.sparkSession, a.n_cols)))


def placed(a):
    """The matrix ready for products with tables: its entries for sparse ones, blocks of columns for dense ones."""
    if isinstance(a, CooMatrix):
        return JoinedMatrix(a)
    return BlockedMatrix.from_tall(a) if isinstance(a, TallMatrix) else a.placed()


# -- direct ---------------------------------------------------------------


def direct_svd(a: TallMatrix | CooMatrix, k: int) -> TruncatedSvd:
    """From the SVD of R; no squaring, so small singular values stay accurate."""
    _check_rank(a, k)
    _, s, vt = np.linalg.svd(tsqr(a).r, full_matrices=False)
    return _from_local_basis(a, s, vt.T, k)


# -- randomized -------------------------------------------------------------


def randomized_svd(
    a: TallMatrix | CooMatrix,
    k: int,
    oversample: int,
    power_iters: int,
    seed: int = 0,
    basis: str = "auto",
) -> TruncatedSvd:
    """Subspace iteration with a QR per round, then the SVD of A Q."""
    _check_rank(a, k)
    a = stored(a)
    width = min(k + oversample, a.n_cols)
    if basis == "auto":
        basis = "local" if fits_locally(a.n_cols, width) else "table"
    if basis == "table":
        return _randomized_tables(a, k, width, power_iters, seed)

    held = in_blocks(a)
    try:
        y = gaussian_matrix(a.df.sparkSession, a.n_cols, width, seed)
        for _ in range(power_iters):
            y = np.linalg.qr(products.gram_times_local(held, y))[0]
        q = np.linalg.qr(y)[0]
        _, s, wt = np.linalg.svd(tsqr(products.times(held, q)).r, full_matrices=False)
        return _from_local_basis(_source(a, held), s, q @ wt.T, k)
    finally:
        held.release()


def _source(a, held):
    """What U is computed from later: the caller's matrix, or the tiles while they are there."""
    return held if isinstance(held, BlockedMatrix) else a


def _draws(width: int, seed: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda j: normal(F.col("row_id"), j, seed)
    )


def gaussian_matrix(spark: SparkSession, n: int, k: int, seed: int) -> np.ndarray:
    """A standard normal start for a local basis, with the values of gaussian_table."""
    rows = all_ids(spark, n).select("row_id", _draws(k, seed).alias("v"))
    return TallMatrix(rows, k).to_numpy()


def orthonormal(y: TallMatrix) -> TallMatrix:
    """Orthonormal columns with the span of y; numerically dependent directions go."""
    for _ in range(2):
        _, s, vt = np.linalg.svd(tsqr(y).r, full_matrices=False)
        kept = int((s > RANK_TOL * s[0]).sum())
        y = right(y, vt.T[:, :kept] / s[:kept])
    return y


def gaussian_table(joined: JoinedMatrix, width: int, seed: int) -> TallMatrix:
    return TallMatrix(joined.column_ids().select("row_id", _draws(width, seed).alias("v")), width)


def _randomized_tables(a, k, width, power_iters, seed) -> TruncatedSvd:
    joined = placed(a)
    try:
        y = orthonormal(_saved(gaussian_table(joined, width, seed)))
        for _ in range(power_iters):
            y = _saved(orthonormal(_saved(joined.gram_times(y))))
        aq = _saved(joined.times(y))
        _, s, wt = np.linalg.svd(tsqr(aq).r, full_matrices=False)
        return _from_table_basis(a, joined, s, y, wt.T, k)
    finally:
        joined.release()


def _saved(x: TallMatrix) -> TallMatrix:
    return TallMatrix(cut_lineage(x.df), x.n_cols)


# -- exact for wide matrices --------------------------------------------------


def krylov_svd(
    a: TallMatrix | CooMatrix,
    k: int,
    tol: float = 1e-13,
    restarts: int = 200,
    seed: int = 0,
    basis: str = "auto",
) -> TruncatedSvd:
    """Block Lanczos on A'A with full reorthogonalization and restarts.

    The basis grows by the residuals of the leading Ritz vectors and is cut back to
    the best of them when it is full. Stops when every wanted residual is at most
    tol times the Ritz value, or as small as rounding allows; raises when that is not
    reached in restarts * 5 steps.
    """
    _check_rank(a, k)
    block = min(k + 2, a.n_cols)
    longest = min(SHORT_BASIS * block, a.n_cols)
    if basis == "auto":
        basis = "local" if fits_locally(a.n_cols, 2 * longest) else "table"
    if basis == "local":
        longest = max(longest, min(LONG_BASIS * block, a.n_cols, MAX_LOCAL_ELEMS // (2 * a.n_cols)))
    space = _LocalSpace(a, seed) if basis == "local" else _TableSpace(a, seed)
    try:
        return _lanczos(space, a.n_cols, k, block, longest, tol, restarts * 5)
    finally:
        space.release()


def _ritz(space) -> tuple[np.ndarray, np.ndarray]:
    theta, z = np.linalg.eigh(space.projected())
    return theta[::-1], z[:, ::-1]


def _lanczos(space, n: int, k: int, block: int, longest: int, tol: float, steps: int) -> TruncatedSvd:
    space.start(block)
    for _ in range(steps):
        theta, z = _ritz(space)
        lead = min(block, len(theta))
        sizes = space.residuals(z[:, :lead], theta[:lead])
        limit = np.maximum(tol * theta[:k], RESIDUAL_FLOOR * theta[0])
        if (sizes[:k] <= limit).all() or space.width >= n:
            return space.finish(z, k)
        if space.width + block > longest:
            space.restart(z[:, : min(2 * block, len(theta))])
        if not space.grow():
            # nothing is outside the basis, which a restart may have turned
            return space.finish(_ritz(space)[1], k)
    worst = float((sizes[:k] / limit).max())
    raise RuntimeError(f"Lanczos did not converge in {steps} steps: a residual is {worst:.2g} times its limit")


class _LocalSpace:
    """Basis V and C V for C = A'A as numpy arrays."""

    def __init__(self, a, seed: int):
        self.a, self.seed = in_blocks(a), seed
        self.source = _source(a, self.a)

    def start(self, block: int) -> None:
        self.v = np.linalg.qr(gaussian_matrix(self.a.df.sparkSession, self.a.n_cols, block, self.seed))[0]
        self.cv = products.gram_times_local(self.a, self.v)
        self.t = self.v.T @ self.cv

    @property
    def width(self) -> int:
        return self.v.shape[1]

    def projected(self) -> np.ndarray:
        return (self.t + self.t.T) / 2

    def residuals(self, z, theta) -> np.ndarray:
        self.r = self.cv @ z - (self.v @ z) * theta
        return np.linalg.norm(self.r, axis=0)

    def restart(self, z) -> None:
        self.v, self.cv = self.v @ z, self.cv @ z
        self.t = self.v.T @ self.cv

    def grow(self) -> bool:
        w = self.r
        for _ in range(2):
            w = w - self.v @ (self.v.T @ w)
            u, s, _ = np.linalg.svd(w, full_matrices=False)
            w = u[:, s > RANK_TOL * max(s[0], 1e-300)]
        w = w[:, : self.a.n_cols - self.width]
        if w.shape[1] == 0:
            return False
        cw = products.gram_times_local(self.a, w)
        # the rest of V'CV is there from the steps before
        self.t = np.block([[self.t, self.v.T @ cw], [w.T @ self.cv, w.T @ cw]])
        self.v, self.cv = np.hstack([self.v, w]), np.hstack([self.cv, cw])
        return True

    def finish(self, z, k: int) -> TruncatedSvd:
        q = np.linalg.qr(self.v @ z[:, :k])[0]
        _, s, wt = np.linalg.svd(tsqr(products.times(self.a, q)).r, full_matrices=False)
        return _from_local_basis(self.source, s, q @ wt.T, k)

    def release(self) -> None:
        self.a.release()


class _TableSpace:
    """The same with one table of rows [V | C V] per column of A."""

    def __init__(self, a, seed: int):
        self.source, self.joined, self.seed = a, placed(a), seed

    def start(self, block: int) -> None:
        v = _saved(orthonormal(_saved(gaussian_table(self.joined, block, self.seed))))
        self.width = v.n_cols
        self.both = self._beside(v, self.joined.gram_times(v))

    def _beside(self, *tables: TallMatrix) -> TallMatrix:
        df = tables[0].df
        for i, t in enumerate(tables[1:]):
            df = df.join(t.df.withColumnRenamed("v", f"v{i}"), "row_id")
        names = ["v"] + [f"v{i}" for i in range(len(tables) - 1)]
        joined = df.select("row_id", F.concat(*names).alias("v"))
        return TallMatrix(cut_lineage(joined), sum(t.n_cols for t in tables))

    def projected(self) -> np.ndarray:
        self.g = products.gram_local(self.both)
        t = self.g[: self.width, self.width : 2 * self.width]
        return (t + t.T) / 2

    def residuals(self, z, theta) -> np.ndarray:
        # R = [V | CV] m, and V'R from the Gram matrix of the same table
        self.m = np.vstack([-z * theta, z])
        return np.linalg.norm(tsqr(right(self.both, self.m)).r, axis=0)

    def restart(self, z) -> None:
        d, k = z.shape
        turn = np.zeros((2 * d, 2 * k))
        turn[:d, :k] = turn[d:, k:] = z
        r = right(self.both, self.m)
        self.both = self._beside(right(self.both, turn), r)
        self.width = k
        # the residuals now sit in the last columns
        lift = np.zeros((self.both.n_cols, r.n_cols))
        lift[2 * k :] = np.eye(r.n_cols)
        self.m = lift
        self.g = products.gram_local(self.both)

    def grow(self) -> bool:
        d = self.width
        m = self.m
        for _ in range(2):
            m = m - np.vstack([self.g[:d] @ m, np.zeros((m.shape[0] - d, m.shape[1]))])
            _, s, vt = np.linalg.svd(tsqr(right(self.both, m)).r, full_matrices=False)
            kept = int((s > RANK_TOL * max(s[0], 1e-300)).sum())
            if kept == 0:
                return False
            m = m @ (vt.T[:, :kept] / s[:kept])
        w = right(self.both, m)
        keep_v = np.zeros((self.both.n_cols, d))
        keep_v[:d] = np.eye(d)
        keep_cv = np.zeros((self.both.n_cols, d))
        keep_cv[d : 2 * d] = np.eye(d)
        w = _saved(w)
        self.both = self._beside(
            right(self.both, keep_v), w, right(self.both, keep_cv), self.joined.gram_times(w)
        )
        self.width = d + w.n_cols
        return True

    def finish(self, z, k: int) -> TruncatedSvd:
        top = np.vstack([z[:, :k], np.zeros_like(z[:, :k])])
        lifted = np.zeros((self.both.n_cols, top.shape[1]))
        lifted[: top.shape[0]] = top
        q = _saved(orthonormal(right(self.both, lifted)))
        aq = _saved(self.joined.times(q))
        _, s, wt = np.linalg.svd(tsqr(aq).r, full_matrices=False)
        return _from_table_basis(self.source, self.joined, s, q, wt.T, k)

    def release(self) -> None:
        self.joined.release()


def in_blocks(a):
    """The matrix as the decompositions pass over it: rows too long for one record each become blocks of columns, sparse rows are packed."""
    if isinstance(a, (TallMatrix, BlockedMatrix)):
        return BlockedMatrix.from_tall(a) if isinstance(a, TallMatrix) and a.n_cols > MAX_DIRECT_COLS else a.keep()
    return PackedSparse(a)


def stored(a):
    """A wide matrix made dense from few entries, or too wide for dense rows, goes on as its entries; any other as it is."""
    if not isinstance(a, TallMatrix) or a.sparse is None or a.n_cols <= MAX_DIRECT_COLS:
        return a
    if a.n_cols > MAX_LOCAL_ELEMS:
        return a.sparse
    sizes = a.sparse.df.agg(F.count("*").alias("n"), F.count_distinct(F.struct("row_id")).alias("rows")).first()
    return a.sparse if sizes.n < SPARSE_SHARE * sizes.rows * a.n_cols else a


def transposed_svd(a: CooMatrix, k: int, seed: int = 0) -> TruncatedSvd | None:
    """By Lanczos on AA', for a matrix with fewer rows than columns; None where the rows are not few enough.

    The basis has a row per row of A, and a pass reads A by columns, which are short.
    """
    entries = keep(a.df)
    try:
        ids = entries.select("row_id").distinct()
        m = ids.count()
        longest = SHORT_BASIS * min(k + 2, m)
        if not k <= m < a.n_cols or not fits_locally(m, 2 * longest):
            return None
        numbers, _ = number_rows(ids, ["row_id"], "at")
        numbers = numbers.withColumnRenamed("row_id", "old")
        # a null row id is a row as well
        side = F.broadcast(numbers) if m <= MAX_BROADCAST_ROWS else numbers
        flipped = entries.join(side, F.col("row_id").eqNullSafe(F.col("old")))
        flipped = flipped.select(F.col("col_id").alias("row_id"), F.col("at").alias("col_id"), "val")
        f = krylov_svd(CooMatrix(flipped, m, canonical=True), k, seed=seed, basis="local")
        v = TallMatrix(cut_lineage(f.u.df), f.u.n_cols)
    finally:
        entries.unpersist()
    signs = np.diag(_table_signs(v))
    u = right(f.v, signs).df.withColumnRenamed("row_id", "at").join(numbers, "at").select(F.col("old").alias("row_id"), "v")
    v = with_rows(right(v, signs), all_ids(a.df.sparkSession, a.n_cols))
    return TruncatedSvd(TallMatrix(u, f.v.n_cols), f.s, v)


def exact_svd(a, k: int, max_direct_cols: int = MAX_DIRECT_COLS, seed: int = 0) -> TruncatedSvd:
    a = stored(a)
    if isinstance(a, CooMatrix) and a.n_cols > MAX_DIRECT_COLS and not fits_locally(a.n_cols, 2 * SHORT_BASIS * (k + 2)):
        found = transposed_svd(a, k, seed)
        if found is not None:
            return found
    if a.n_cols <= min(max_direct_cols, MAX_DIRECT_COLS) and not isinstance(a, BlockedMatrix):
        return direct_svd(a, k)
    return krylov_svd(a, k, seed=seed)
