"""Centering, scaling and weighting of rows and columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.frames import TallMatrix
from tallmat.functions import arrays

# fixed names of the preprocessing methods
METHODS = (
    "none",
    "centerOverAllObservations",
    "standardizeEach",
    "cosLat+centerOverAllObservations",
)

NEGATIVES = ("keep", "error", "clamp_log")
NEGATIVE = "matrix has a negative element"


def center_rows(a: TallMatrix, stats: DataFrame | None = None) -> TallMatrix:
    """Subtract each row's mean, its own or the one in `stats(row_id, mean)`."""
    if stats is None:
        return a.with_v(arrays.shifted(F.col("v"), arrays.mean(F.col("v"))))
    joined = a.df.join(stats.select("row_id", "mean"), "row_id", "left")
    mean = required(F.col("mean"), "no mean for row ")
    return TallMatrix(
        joined.select("row_id", arrays.shifted(F.col("v"), mean).alias("v")), a.n_cols
    )


def standardize_rows(a: TallMatrix, stats: DataFrame | None = None) -> TallMatrix:
    """(x - mean) / std per row; a low std counts as 1."""
    if stats is None:
        v = F.col("v")
        std = arrays.usable_std(arrays.deviation(v))
        return a.with_v(arrays.scaled(arrays.shifted(v, arrays.mean(v)), 1.0 / std))
    joined = a.df.join(stats.select("row_id", "mean", "std"), "row_id", "left")
    mean, std = required(F.col("mean"), "no mean for row "), F.col("std")
    v = arrays.scaled(arrays.shifted(F.col("v"), mean), 1.0 / std)
    return TallMatrix(joined.select("row_id", v.alias("v")), a.n_cols)


def weight_rows(a: TallMatrix, weights: DataFrame) -> TallMatrix:
    """Multiply row i by its weight from `weights(row_id, weight)`."""
    joined = a.df.join(weights.select("row_id", "weight"), "row_id", "left")
    v = arrays.scaled(F.col("v"), required(F.col("weight"), "no weight for row "))
    return TallMatrix(joined.select("row_id", v.alias("v")), a.n_cols)


def required(value, message: str):
    text = F.concat(F.lit(message), F.col("row_id").cast("string"))
    return F.when(value.isNull(), F.raise_error(text).cast("double")).otherwise(value)


def weight_means(row_stats: DataFrame) -> DataFrame:
    """(row_id, val): the row means times the row weights."""
    return row_stats.select("row_id", (F.col("mean") * F.col("weight")).alias("val"))


def latitude_weights(latitudes: DataFrame) -> DataFrame:
    """(row_id, weight) from (row_id, lat) in degrees."""
    return latitudes.select("row_id", arrays.latitude_weight(F.col("lat")).alias("weight"))


def preprocess(
    a: TallMatrix, method: str, weights: DataFrame | None = None
) -> tuple[TallMatrix, DataFrame]:
    """The prepared matrix and row_stats(row_id, mean, std, weight, weighted_mean, low_std)."""
    if method not in METHODS:
        raise ValueError(f"unknown preprocessing {method!r}; one of {', '.join(METHODS)}")
    weighted = method.startswith("cosLat+")
    if weighted and weights is None:
        raise ValueError(f"{method} needs weights(row_id, weight)")

    def weigh(df: DataFrame) -> DataFrame:
        if not weighted:
            return df.withColumn("weight", F.lit(1.0))
        df = df.join(weights.select("row_id", "weight"), "row_id", "left")
        return df.withColumn("weight", required(F.col("weight"), "no weight for row "))

    base = weigh(a.df)
    v = F.col("v")
    raw_std = arrays.deviation(v)
    stats = base.select("row_id", "weight", arrays.mean(v).alias("mean"), raw_std.alias("raw"))
    row_stats = stats.select(
        "row_id",
        "mean",
        arrays.usable_std(F.col("raw")).alias("std"),
        "weight",
        (F.col("mean") * F.col("weight")).alias("weighted_mean"),
        (F.col("raw") < arrays.LOW_STD).alias("low_std"),
    )

    # row statistics are local to the row: no join and no second pass
    if method != "none":
        v = arrays.shifted(v, arrays.mean(v))
    if method == "standardizeEach":
        v = arrays.scaled(v, 1.0 / arrays.usable_std(raw_std))
    if weighted:
        v = arrays.scaled(v, F.col("weight"))
    prepared = base.select("row_id", v.alias("v"))
    source, read = a.blocks()
    source = weigh(source) if weighted else source
    read = _prepared_blocks(read, a.n_cols, method, weighted)
    matrix = TallMatrix(prepared, a.n_cols, blocks=(source, read))
    if method == "none":
        matrix.sparse = a.sparse
    return matrix, row_stats


def _prepared_blocks(read_raw, n: int, method: str, weighted: bool):
    """The same preparation on the numpy blocks of `read_raw`, with a weight per row."""

    def read(batch):
        start = 0
        for row_ids, x in read_raw(batch):
            if method != "none":
                x = x - x.mean(axis=1, keepdims=True)
            if method == "standardizeEach" and n > 1:
                std = np.sqrt((x * x).sum(axis=1, keepdims=True) / (n - 1))
                x = x / np.where(std < arrays.LOW_STD, 1.0, std)
            if weighted:
                x = x * batch.column("weight").to_numpy()[start : start + len(x), None]
            start += len(x)
            yield row_ids, x

    return read


def clamp_log(a: TallMatrix) -> TallMatrix:
    """0 for a negative element, log(1 + x) otherwise."""
    return a.map_elements(arrays.clamp_log)


def count_negative(a: TallMatrix) -> DataFrame:
    """One record: how many rows hold a negative element, and the smallest element."""
    lowest = a.df.select(F.array_min("v").alias("low"))
    return lowest.agg(
        F.count_if(F.col("low") < 0).alias("rows_with_negative"), F.min("low").alias("smallest")
    )


def non_negative(a: TallMatrix, negatives: str = "error") -> TallMatrix:
    """Treat negative input: keep it, raise when it is read, or clamp and take logs."""
    if negatives not in NEGATIVES:
        raise ValueError(f"unknown mode {negatives!r}; one of {', '.join(NEGATIVES)}")
    if negatives == "keep":
        return a
    source, read = a.blocks()
    if negatives == "clamp_log":
        blocks = (source, _clamp_log_blocks(read))
        return TallMatrix(clamp_log(a).df, a.n_cols, blocks)
    failure = F.raise_error(F.lit(NEGATIVE)).cast("array<double>")
    checked = F.when(F.array_min("v") < 0, failure).otherwise(F.col("v"))
    return TallMatrix(a.with_v(checked).df, a.n_cols, (source, _checked_blocks(read)))


def _clamp_log_blocks(read_raw):
    def read(batch):
        for row_ids, x in read_raw(batch):
            yield row_ids, np.log1p(np.maximum(x, 0.0))

    return read


def _checked_blocks(read_raw):
    def read(batch):
        for row_ids, x in read_raw(batch):
            if (x < 0).any():
                raise ValueError(NEGATIVE)
            yield row_ids, x

    return read


def unit_l1_factors(col_l1: np.ndarray) -> np.ndarray:
    """1 / norm per column, and 0 for an all-zero column."""
    return np.divide(1.0, col_l1, out=np.zeros_like(col_l1), where=col_l1 > 0)


def scale_columns(a: TallMatrix, factors: np.ndarray) -> TallMatrix:
    """Multiply column j by factors[j]."""
    if len(factors) != a.n_cols:
        raise ValueError(f"{len(factors)} factors for {a.n_cols} columns")
    literal = F.lit([float(x) for x in factors])
    return a.with_v(F.zip_with(F.col("v"), literal, lambda x, c: x * c))
