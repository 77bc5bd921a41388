"""Row, column and whole-matrix reductions; results are DataFrames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix, TallMatrix
from tallmat.functions import arrays
from tallmat.operators import batches as codec
from tallmat.operators.fold import element_batch, fold, ship, unpack
from tallmat.operators.products import paired_rows

# Up to this width a column reduction is one built-in aggregate per column.
UNROLLED_COLS = 32

# Exploded elements are aggregated in compiled code, which a lambda per row is not.
WHOLE = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}


def _elements(a: TallMatrix) -> DataFrame:
    return a.df.select(F.explode("v").alias("x"))


def reduce_all(a: TallMatrix, how: str) -> DataFrame:
    """One record `val`: sum, min, max or product of all elements."""
    return _elements(a).agg(WHOLE[how]("x").alias("val"))


def aggregate_all(
    a: TallMatrix,
    zero: Column,
    seq: Callable[[Column, Column], Column],
    combine: Callable[[Column], Column],
) -> DataFrame:
    """General aggregate: fold each row from `zero` with `seq`, then a Spark aggregate
    such as F.sum or F.max over the row results."""
    return a.df.agg(combine(F.aggregate("v", zero, seq)).alias("val"))


def aggregate_blocks(
    a: TallMatrix | CooMatrix,
    seq: Callable[[np.ndarray], np.ndarray],
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray],
    n_out: int,
) -> DataFrame:
    """(pos, val): any user aggregate with n_out values.

    `seq` turns a block of rows into n_out numbers, `combine` merges two results and
    must be associative and commutative. Unlike the built-in reductions this runs in
    Python, on whole blocks.
    """
    df, read = a.blocks()

    def local(batches):
        acc = None
        for batch in batches:
            for _, x in read(batch):
                if len(x):
                    part = np.asarray(seq(x), dtype=np.float64).reshape(n_out, 1)
                    acc = part if acc is None else combine(acc, part)
        if acc is not None:
            yield 0, acc

    merged = fold(df, local, combine)
    values = merged.mapInArrow(_part_values, "pos BIGINT, val DOUBLE")
    return values


def _part_values(batches):
    for batch in batches:
        for _, x in unpack(batch):
            yield element_batch(x[:, 0])


def reduce_with(a: TallMatrix | CooMatrix, f: np.ufunc) -> DataFrame:
    """One record `val`: all elements folded with a binary numpy function."""
    return aggregate_blocks(a, lambda x: f.reduce(x, axis=None), f, 1).select("val")


def reduce_cols_with(a: TallMatrix | CooMatrix, f: np.ufunc) -> DataFrame:
    """(col_id, val): every column folded with a binary numpy function."""
    folded = aggregate_blocks(a, lambda x: f.reduce(x, axis=0), f, a.n_cols)
    return folded.withColumnRenamed("pos", "col_id")


def reduce_rows(a: TallMatrix, f: Callable[[Column, Column], Column]) -> DataFrame:
    """(row_id, val): each row folded with f."""
    return a.df.select("row_id", arrays.reduce_elements(F.col("v"), f).alias("val"))


def reduce_cols(a: TallMatrix, agg: Callable[[Column], Column]) -> DataFrame:
    """(col_id, val): a Spark aggregate (F.sum, F.max, ...) over each column.

    One record per column at every width; NULL when the matrix has no rows.
    """
    if a.n_cols > UNROLLED_COLS:
        ids = a.df.sparkSession.range(a.n_cols).withColumnRenamed("id", "col_id")
        values = a.entries().groupBy("col_id").agg(agg(F.col("val")).alias("val"))
        return ids.join(values, "col_id", "left")
    columns = [agg(F.col("v")[j]).alias(f"c{j}") for j in range(a.n_cols)]
    wide = a.df.agg(*columns).select(F.array(*[f"c{j}" for j in range(a.n_cols)]).alias("v"))
    exploded = wide.select(F.posexplode("v").alias("col_id", "val"))
    return exploded.select(F.col("col_id").cast("bigint").alias("col_id"), "val")


def reduce_coo(a: CooMatrix, key: str, agg: Callable[[Column], Column]) -> DataFrame:
    """(row_id or col_id, val): an aggregate over the stored entries of each row or column."""
    return a.df.groupBy(key).agg(agg(F.col("val")).alias("val"))


def row_sums(a: TallMatrix) -> DataFrame:
    return a.df.select("row_id", arrays.total(F.col("v")).alias("val"))


def col_sums(a: TallMatrix) -> DataFrame:
    return reduce_cols(a, F.sum)


def col_norms_l1(a: TallMatrix) -> DataFrame:
    return reduce_cols(a, lambda x: F.sum(F.abs(x)))


def col_norms_l2(a: TallMatrix) -> DataFrame:
    return reduce_cols(a, lambda x: F.sqrt(F.sum(x * x)))


def frobenius(a: TallMatrix | CooMatrix) -> DataFrame:
    """One record `val`: the square root of the sum of squares."""
    if isinstance(a, CooMatrix):
        return a.df.agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("val"))
    return _elements(a).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("val"))


def row_means(a: TallMatrix | CooMatrix) -> DataFrame:
    """(row_id, val); absent sparse entries count as 0."""
    if isinstance(a, CooMatrix):
        return reduce_coo(a, "row_id", lambda x: F.sum(x) / a.n_cols)
    return a.df.select("row_id", arrays.mean(F.col("v")).alias("val"))


def row_mean_std(a: TallMatrix | CooMatrix) -> DataFrame:
    """(row_id, mean, std, low_std): sample deviation, replaced by 1 where it is too low."""
    if isinstance(a, CooMatrix):
        stats = _sparse_mean_std(a)
    else:
        raw = arrays.deviation(F.col("v"))
        stats = a.df.select("row_id", arrays.mean(F.col("v")).alias("mean"), raw.alias("raw"))
    return stats.select(
        "row_id",
        "mean",
        arrays.usable_std(F.col("raw")).alias("std"),
        (F.col("raw") < arrays.LOW_STD).alias("low_std"),
    )


def _sparse_mean_std(a: CooMatrix) -> DataFrame:
    """(row_id, mean, raw): by two passes over the stored entries; absent ones are 0."""
    n, v = a.n_cols, F.col("val")
    rows = a.sparse_rows().select("row_id", "val", (arrays.total(v) / n).alias("mean"))
    stored = arrays.let(F.col("mean"), lambda m: arrays.total_squares(F.transform(v, lambda x: x - m)))
    squares = stored + (n - F.size(v)) * F.col("mean") * F.col("mean")
    raw = F.sqrt(squares / (n - 1)) if n > 1 else F.lit(0.0)
    return rows.select("row_id", "mean", raw.alias("raw"))


def _errors(a: TallMatrix, left: TallMatrix, right: np.ndarray) -> DataFrame:
    """One record (sse, ssq): squared error of L R and squared norm of A, in one pass."""
    n, k = a.n_cols, left.n_cols
    if right.shape != (k, n):
        raise ValueError(f"right factor is {right.shape}, expected {(k, n)}")
    get = ship(a.df.sparkSession, right)

    def run(batches):
        sums = np.zeros((1, 2))
        for batch in batches:
            x = codec.dense_block(batch.column("a"), n)
            diff = x - codec.dense_block(batch.column("b"), k) @ get()
            sums += [(diff * diff).sum(), (x * x).sum()]
        yield codec.sums_batch(sums)

    partial = paired_rows(a, left).mapInArrow(run, "sse DOUBLE, ssq DOUBLE")
    return partial.agg(F.sum("sse").alias("sse"), F.sum("ssq").alias("ssq"))


def squared_error(a: TallMatrix, left: TallMatrix, right: np.ndarray) -> DataFrame:
    """One record `val`: the sum over rows of ||a_i - (L R)_i||^2, L a table, R local."""
    return _errors(a, left, right).select(F.col("sse").alias("val"))


def block_error(
    a: TallMatrix | CooMatrix, approximate: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    """One record (sse, ssq) for an approximation that depends on the rows alone.

    Where the left factor is computed from A's own rows, this takes one pass and no
    join: `approximate` maps a block of rows to the rows that stand for it.
    """
    df, read = a.blocks()

    def run(batches):
        sums = np.zeros((1, 2))
        for batch in batches:
            for _, x in read(batch):
                diff = x - approximate(x)
                sums += [(diff * diff).sum(), (x * x).sum()]
        yield codec.sums_batch(sums)

    partial = df.mapInArrow(run, "sse DOUBLE, ssq DOUBLE")
    return partial.agg(F.sum("sse").alias("sse"), F.sum("ssq").alias("ssq"))


def relative_error(a: TallMatrix, left: TallMatrix, right: np.ndarray) -> DataFrame:
    """One record `val`: ||A - L R|| / ||A||."""
    return _errors(a, left, right).select(F.sqrt(F.col("sse") / F.col("ssq")).alias("val"))
