"""QR and least squares of matrices with too many columns for one R factor.

Columns are taken in panels. A panel is factored by two tall-and-skinny QR passes, then taken out of all columns behind
it; what is left of the rows is written and read as the next panel's input, so rows get shorter and lineage stays short.
A task or the driver holds one factor of `width` by n values at a time, of checked size; R is a table of rows.

Taking panels out one after the other gives an R, and solutions with the right-hand sides as trailing columns, as
accurate as by reflections. Q alone loses orthogonality with the condition of A, so `thin_qr` runs a second round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.frames import ROW_SCHEMA, CooMatrix, TallMatrix
from tallmat.operators import batches as codec
from tallmat.operators.fold import MatrixSum, check_local, ship
from tallmat.operators.products import local_rows
from tallmat.operators.tsqr import RANK_TOL, _tsqr
from tallmat.session import MAX_LOCAL_ELEMS, scratch_path

PANEL_COLS = 512


@dataclass
class PanelQr:
    """R (a table, one record per row), column L1 norms, row count, and how many columns depend on earlier ones.

    R has a non-negative diagonal. `rest` has the trailing columns that were asked to stay, less their part in the range of
    the others; `q`, where asked for, the orthonormal columns.
    """

    r: TallMatrix
    panels: list[tuple[int, int]]
    col_l1: np.ndarray
    n_rows: int
    dependent: int
    rest: TallMatrix | None
    q: TallMatrix | None


def panel_width(n: int, width: int | None = None) -> int:
    check_local(1, n)
    return min(width or PANEL_COLS, n, MAX_LOCAL_ELEMS // n)


def _header(a: TallMatrix | CooMatrix) -> np.ndarray:
    """Rows: L1 norms, squared norms, row count."""
    df, read = a.blocks()

    def local(batches):
        acc = None
        for batch in batches:
            for ids, x in read(batch):
                h = np.vstack([np.abs(x).sum(axis=0), (x * x).sum(axis=0), np.full(x.shape[1], len(ids))])
                acc = h if acc is None else acc + h
        return acc

    return MatrixSum(df, local, 3, a.n_cols).to_numpy()


class _Basis:
    """Q of the panel x = columns [at, at + w) of the rows, and the k x w triangle with x = (Q turn) r.

    Columns count by their original lengths (`norms`): what is left of one must be more than RANK_TOL of it.
    """

    def __init__(self, df: DataFrame, read, at: int, norms: np.ndarray):
        spark, w = df.sparkSession, len(norms)

        def panel(batch) -> Iterator:
            for ids, x in read(batch):
                yield ids, x[:, at : at + w]

        def rough(batch) -> Iterator:
            for ids, x in panel(batch):
                yield ids, x @ self._first()

        down = np.divide(1.0, norms, out=np.zeros(w), where=norms > 0)
        _, s, vt = np.linalg.svd(_tsqr(df, panel, w).r * down, full_matrices=False)
        self.k = k = int((s > RANK_TOL).sum())
        self.at, self.w = at, w
        self._first = ship(spark, down[:, None] * vt[:k].T / s[:k])
        again = _tsqr(df, rough, k).r if k else np.zeros((0, 0))
        # applied one after the other: the second step mends what the first one lost
        self._second = ship(spark, np.linalg.inv(again))
        turn, r = np.linalg.qr(again @ (s[:k, None] * vt[:k] * norms))
        signs = np.where(np.diag(r) < 0, -1.0, 1.0)
        self.turn, self.r = turn * signs, np.triu(r) * signs[:, None]

    def of(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.at : self.at + self.w] @ self._first() @ self._second()

    def behind(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.at + self.w :]

    def release(self) -> None:
        self._first.release()
        self._second.release()


def panel_qr(a: TallMatrix | CooMatrix, width: int | None = None, trailing: int = 0, with_q: bool = False) -> PanelQr:
    """R of A = QR by panels of columns, for any number of columns up to MAX_LOCAL_ELEMS.

    The last `trailing` columns are not factored: R has their products with Q, and what is left of them is `rest`. With
    `with_q` the rows keep their full length, as columns of Q take the place of those of A. A column that depends on
    earlier ones has a zero on the diagonal; R'R = A'A holds all the same.
    """
    n, spark = a.n_cols, a.df.sparkSession
    last = n - trailing
    if last < 1:
        raise ValueError("no columns to factor")
    width = panel_width(n, width)
    l1, squares, counts = _header(a)
    panels = [(s, min(s + width, last)) for s in range(0, last, width)]
    r_path = scratch_path(spark, "panel-r")
    df, read = a.blocks()
    left, gone, dependent = None, 0, 0
    for start, stop in panels:
        basis = _Basis(df, read, start - gone, np.sqrt(squares[start:stop]))
        k = basis.k
        dependent += stop - start - k
        rows = np.zeros((stop - start, n))
        rows[:k, start:stop] = basis.r
        off = _products(df, read, basis, n - stop) if k and stop < n else np.zeros((k, n - stop))
        rows[:k, stop:] = basis.turn.T @ off
        local_rows(spark, rows, start).df.write.mode("append").parquet(r_path)
        if with_q or stop < n:
            gone = 0 if with_q else stop
            left = TallMatrix(_taken_out(df, read, basis, off, with_q), n - gone)
            df, read = left.blocks()
        basis.release()
    return PanelQr(
        TallMatrix(spark.read.schema(ROW_SCHEMA).parquet(r_path), n),
        panels,
        l1[:last],
        int(counts[0]),
        dependent,
        left.col_slice(last - gone, n - gone) if trailing else None,
        left.col_slice(0, last) if with_q else None,
    )


def _products(df: DataFrame, read, basis: _Basis, behind: int) -> np.ndarray:
    """Q'X for the panel's Q and the columns X behind it."""

    def local(batches):
        acc = None
        for batch in batches:
            for _, x in read(batch):
                z = basis.behind(x).T @ basis.of(x)
                acc = z if acc is None else np.add(acc, z, out=acc)
        return acc

    return MatrixSum(df, local, behind, basis.k).to_numpy().T


def _taken_out(df: DataFrame, read, basis: _Basis, off: np.ndarray, with_q: bool) -> DataFrame:
    """The rows without the panel and without its part in the columns behind, written and read again."""
    spark = df.sparkSession
    sent = ship(spark, off)

    def run(batches):
        for batch in batches:
            for ids, x in read(batch):
                q = basis.of(x)
                v = basis.behind(x) - q @ sent()
                if with_q:
                    own = np.zeros((len(x), basis.w))
                    own[:, : basis.k] = q @ basis.turn
                    v = np.hstack([x[:, : basis.at], own, v])
                yield codec.rows_batch(ids, v)

    path = scratch_path(spark, "panel-rows")
    df.mapInArrow(run, ROW_SCHEMA).write.parquet(path)
    sent.release()
    return spark.read.schema(ROW_SCHEMA).parquet(path)


def _refuse_dependent(found: PanelQr, what: str) -> None:
    if found.dependent:
        raise ValueError(f"{what} needs a matrix of full column rank")


def triangular_product(left: PanelQr, right: TallMatrix) -> TallMatrix:
    """L R of two factors, a panel of rows of L after the other."""
    n, spark = right.n_cols, right.df.sparkSession
    path = scratch_path(spark, "panel-r")
    for start, stop in left.panels:
        factor = ship(spark, _panel_rows(left.r, start, stop))

        def local(batches, factor=factor):
            acc = None
            for batch in batches:
                z = factor()[:, batch.column("row_id").to_numpy()] @ codec.dense_block(batch.column("v"), n)
                acc = z if acc is None else np.add(acc, z, out=acc)
            return acc

        rows = MatrixSum(right.df.where(F.col("row_id") >= start), local, stop - start, n).to_numpy()
        local_rows(spark, np.triu(rows, start), start).df.write.mode("append").parquet(path)
        factor.release()
    return TallMatrix(spark.read.schema(ROW_SCHEMA).parquet(path), n)


def _panel_rows(r: TallMatrix, start: int, stop: int) -> np.ndarray:
    check_local(stop - start, r.n_cols)
    rows = r.df.where(F.col("row_id").between(start, stop - 1)).toArrow().sort_by("row_id")
    return codec.dense_block(rows.column("v").combine_chunks(), r.n_cols)


def thin_qr(a: TallMatrix, width: int | None = None) -> tuple[TallMatrix, TallMatrix]:
    """Q and R, both tables; the second round makes Q orthonormal to rounding."""
    first = panel_qr(a, width, with_q=True)
    _refuse_dependent(first, "thin QR")
    second = panel_qr(first.q, width, with_q=True)
    return second.q, triangular_product(second, first.r)


def back_substituted(found: PanelQr, q: int) -> np.ndarray:
    """X with R X = Q'B for the q trailing columns B, from the last panel to the first."""
    n = found.r.n_cols - q
    check_local(n, q)
    x = np.zeros((n, q))
    for start, stop in reversed(found.panels):
        later = ship(found.r.df.sparkSession, x[stop:])
        w = stop - start

        def run(batches, later=later, start=start, stop=stop):
            for batch in batches:
                v = codec.dense_block(batch.column("v"), n + q)
                # the triangle of the panel beside what it must give
                target = v[:, n:] - v[:, stop:n] @ later()
                yield codec.rows_batch(batch.column("row_id"), np.hstack([v[:, start:stop], target]))

        own = found.r.df.where(F.col("row_id").between(start, stop - 1)).mapInArrow(run, ROW_SCHEMA)
        both = _panel_rows(TallMatrix(own, w + q), start, stop)
        x[start:stop] = np.linalg.solve(both[:, :w], both[:, w:])
        later.release()
    return x


def least_squares(a: TallMatrix, q: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(X, residual norms) for the last q columns of `a` as right-hand sides."""
    found = panel_qr(a, width, trailing=q)
    _refuse_dependent(found, "least squares")
    return back_substituted(found, q), np.sqrt(_header(found.rest)[1])


def ridge(a: TallMatrix, q: int, lambdas: Sequence[float], width: int | None = None) -> list[np.ndarray]:
    """A solution per lambda; A itself is read for one R, the rest works on the n rows of R."""
    found = panel_qr(a, width, trailing=q)
    solutions = []
    for lam in lambdas:
        again = found
        if lam:
            below = _scaled_identity(found.r.df.sparkSession, a.n_cols - q, a.n_cols, float(np.sqrt(lam)))
            again = panel_qr(TallMatrix(found.r.df.unionByName(below), a.n_cols), width, trailing=q)
        _refuse_dependent(again, "ridge with this lambda")
        solutions.append(back_substituted(again, q))
    return solutions


def _scaled_identity(spark, n: int, n_cols: int, scale: float) -> DataFrame:
    """n rows, after the n rows of R, with `scale` on the diagonal."""
    step = max(1, MAX_LOCAL_ELEMS // 16 // n_cols)

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for at in range(0, len(ids), step):
                some = ids[at : at + step]
                v = np.zeros((len(some), n_cols))
                v[np.arange(len(some)), some] = scale
                yield codec.rows_batch(pa.array(n + some), v)

    return spark.range(n).mapInArrow(run, ROW_SCHEMA)
