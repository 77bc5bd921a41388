"""Whole jobs from stored input to stored result, as run by `python -m tallmat`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix
from tallmat.operators import products
from tallmat.operators.cx import CxScores, cx_scores
from tallmat.operators.nmf import NmfModel, nmf
from tallmat.operators.pca import PcaModel, pca
from tallmat.sources import readers, sinks
from tallmat.sources.index import compact

# fixed names of the sparse input kinds
MATRIX_KINDS = ("csv", "idxrow", "df", "mm")


def pca_job(
    spark: SparkSession,
    manifest: str,
    k: int,
    out: str,
    preprocess: str = "centerOverAllObservations",
    method: str = "exact",
    weights: DataFrame | None = None,
    seed: int = 0,
) -> PcaModel | tuple[PcaModel, PcaModel]:
    """Manifest to saved model; `both` saves to `<out>exact` and `<out>inexact`."""
    a = readers.read_manifest(spark, manifest)
    models = pca(a, k, preprocess, method, weights, seed=seed)
    if method == "both":
        for model, suffix in zip(models, ("exact", "inexact")):
            model.save(out + suffix)
    else:
        models.save(out)
    return models


def read_sparse(
    spark: SparkSession, kind: str, path: str, n_rows: int = 0, n_cols: int = 0
) -> tuple[CooMatrix, int]:
    """A sparse matrix and its row count; sizes of 0 are taken from the data."""
    if kind == "df":
        return readers.read_compacted(spark, path, n_rows, n_cols)
    if kind == "csv":
        a = readers.read_coo_csv(spark, path, n_cols or None)
    elif kind == "idxrow":
        if not n_cols:
            raise ValueError("saved rows need the number of columns")
        a = readers.read_segments(spark, path, n_cols)
    elif kind == "mm":
        matrix = readers.read_matrix_market_checked(spark, path)
        return matrix.coo(), matrix.n_rows
    else:
        raise ValueError(f"unknown kind {kind!r}; one of {', '.join(MATRIX_KINDS)}")
    return a, n_rows or (a.df.agg(F.max("row_id")).first()[0] or 0) + 1


def cx_job(
    spark: SparkSession,
    kind: str,
    path: str,
    rank: int,
    slack: int,
    iters: int,
    out: str,
    n_rows: int = 0,
    n_cols: int = 0,
    parts: int = 0,
    seed: int = 0,
) -> CxScores:
    """Scores for every row and column of the stated shape, 0 where a row has no entry."""
    a, n_rows = read_sparse(spark, kind, path, n_rows, n_cols)
    if parts:
        a = a.coalesce(parts)
    scores = cx_scores(a, rank, slack, iters, seed)
    full = CxScores(
        scores.s,
        scores.dense_rows(spark.range(n_rows).toDF("row_id")),
        scores.dense_cols(spark.range(a.n_cols).toDF("col_id")),
        scores.svd,
    )
    full.save(out)
    return full


def compact_job(spark: SparkSession, path: str, out: str) -> None:
    """Lines `column,row,value` over any integer ids to a matrix over dense ids."""
    schema = "col_key BIGINT, row_key BIGINT, val DOUBLE"
    lines = spark.read.schema(schema).option("mode", "FAILFAST").csv(path)
    compacted = compact(lines)
    sinks.save_compacted(compacted, out)
    sinks.write_dictionary(compacted.rows, "row_key", "row_id", f"{out}/rowtab.txt")
    sinks.write_dictionary(compacted.cols, "col_key", "col_id", f"{out}/coltab.txt")


def nmf_job(
    spark: SparkSession,
    path: str,
    column: str,
    row_id: str,
    r: int,
    out: str,
    partitions: int | None = None,
    negatives: str = "clamp_log",
    return_w: bool = False,
) -> NmfModel:
    a = readers.read_dense(spark, path, column, row_id, partitions)
    model = nmf(a, r, negatives=negatives, return_w=return_w)
    model.save(out)
    return model


def export_job(spark: SparkSession, model: str, out: str) -> None:
    sinks.export_model(PcaModel.load(spark, model), out)


def gram_check_job(spark: SparkSession, path: str, out: str, k: int = 32) -> None:
    """A'A times a matrix of ones, from and to Matrix Market, for outside comparison."""
    a = readers.read_matrix_market(spark, path).coo()
    product = products.gram_times(a, np.ones((a.n_cols, k)))
    sinks.write_tall_matrix_market(product, a.n_cols, out)
