"""Truncated PCA of a tall matrix: preprocess, factor, save."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix, TallMatrix
from tallmat.functions import arrays
from tallmat.operators.blocked import BlockedMatrix
from tallmat.operators.centered import CenteredSparse, prepare_sparse
from tallmat.operators.fold import fits_locally, ship
from tallmat.operators.preprocess import preprocess as prepare
from tallmat.operators.products import gram_local
from tallmat.operators.stats import block_error
from tallmat.operators.svd import TruncatedSvd, exact_svd, randomized_svd, stored
from tallmat.session import MAX_DIRECT_COLS, keep

# fixed defaults of the randomized method
OVERSAMPLE = 5
POWER_ITERS = 10

METHODS = ("exact", "randomized", "both")


@dataclass
class PcaModel:
    """u(row_id, v[k]), v(row_id = column id, v[k]), s(comp, s), row_stats.

    row_stats(row_id, mean, std, weight, weighted_mean, low_std) describes what the
    preprocessing did.
    """

    u: TallMatrix
    s: DataFrame
    v: TallMatrix
    row_stats: DataFrame
    meta: dict = field(default_factory=dict)
    matrix: TallMatrix | CooMatrix | CenteredSparse | None = None

    @property
    def k(self) -> int:
        return self.u.n_cols

    def singular_values(self) -> np.ndarray:
        return np.array([row.s for row in self.s.orderBy("comp").collect()])

    def right_factor(self) -> np.ndarray:
        """diag(s) V' as a local k x n matrix."""
        return self.singular_values()[:, None] * self.v.to_numpy().T

    def squared_error(self) -> DataFrame:
        """One record `val`: squared error of the rank-k approximation, added up from residuals.

        U S V' is A V V', so the rows of A suffice where V fits a task; with a V as a table, dense matrices meet both factors tile by
        tile, or entry by entry where they are made of few entries. Only a sparse matrix with such a V takes ||A||^2 minus the squared singular values. A loaded model
        has no matrix; use stats.squared_error with u and right_factor().
        """
        dense = isinstance(self.matrix, TallMatrix)
        stored = self._stored()
        if stored is not None:
            return self._error_by_entries(stored)
        if dense and (self.meta["n"] > MAX_DIRECT_COLS or not fits_locally(self.meta["n"], self.k)):
            s = F.lit([float(x) for x in self.singular_values()])
            scaled = self.u.with_v(F.zip_with("v", s, lambda x, c: x * c))
            return BlockedMatrix.from_tall(self.matrix).squared_error(scaled, self.v)
        if not fits_locally(self.meta["n"], self.k):
            explained = float((self.singular_values() ** 2).sum())
            return self.matrix.squared_norm().select((F.col("val") - explained).alias("val"))
        v = ship(self.s.sparkSession, self.v.to_numpy())
        errors = block_error(self.matrix, lambda x: (x @ v()) @ v().T)
        return errors.select(F.col("sse").alias("val"))

    def _stored(self) -> CooMatrix | None:
        """The entries of a wide dense matrix made of few of them."""
        kept = stored(self.matrix) if isinstance(self.matrix, TallMatrix) else None
        return kept if isinstance(kept, CooMatrix) else None

    def _error_by_entries(self, a: CooMatrix) -> DataFrame:
        """Residuals at the stored entries, and the squared approximation U S V' at the zeros."""
        s = self.singular_values()
        u, v = (TallMatrix(keep(x.df), x.n_cols) for x in (self.u, self.v))
        whole = float((np.outer(s, s) * gram_local(u) * gram_local(v)).sum())
        weights = F.lit([float(x) for x in s])
        left = u.df.select(F.col("row_id").alias("u_id"), F.zip_with("v", weights, lambda x, c: x * c).alias("u"))
        met = a.df.join(left, F.col("row_id").eqNullSafe(F.col("u_id")))
        met = met.join(v.df.select(F.col("row_id").alias("col_id"), "v"), "col_id")
        p = arrays.total(F.zip_with("u", "v", lambda x, y: x * y))
        rest = met.select("val", p.alias("p")).agg(F.sum((F.col("val") - F.col("p")) ** 2 - F.col("p") ** 2).alias("val"))
        return rest.select((F.coalesce("val", F.lit(0.0)) + whole).alias("val"))

    def save(self, path: str) -> None:
        """One Parquet table per part and a one-record `meta` with the dimensions."""
        self.u.df.write.parquet(f"{path}/u")
        self.v.df.write.parquet(f"{path}/v")
        self.s.write.parquet(f"{path}/s")
        self.row_stats.write.parquet(f"{path}/row_stats")
        spark = self.s.sparkSession
        # counted from the written table, so the factor is computed once
        rows = spark.read.parquet(f"{path}/u").count()
        meta = {**self.meta, "k": self.k, "m": rows}
        columns = [F.lit(value).alias(name) for name, value in sorted(meta.items())]
        spark.range(1).select(*columns).write.parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PcaModel:
        meta = spark.read.parquet(f"{path}/meta").first().asDict()
        k = meta["k"]
        return cls(
            TallMatrix(spark.read.parquet(f"{path}/u"), k),
            spark.read.parquet(f"{path}/s"),
            TallMatrix(spark.read.parquet(f"{path}/v"), k),
            spark.read.parquet(f"{path}/row_stats"),
            meta,
        )


def _model(svd: TruncatedSvd, matrix, row_stats, meta) -> PcaModel:
    spark = row_stats.sparkSession
    s = spark.createDataFrame([(i, float(x)) for i, x in enumerate(svd.s)], "comp BIGINT, s DOUBLE")
    return PcaModel(svd.u, s, svd.v, row_stats, meta, matrix)


def pca(
    a: TallMatrix | CooMatrix,
    k: int,
    preprocess: str = "centerOverAllObservations",
    method: str = "exact",
    weights: DataFrame | None = None,
    oversample: int = OVERSAMPLE,
    power_iters: int = POWER_ITERS,
    seed: int = 0,
    max_direct_cols: int = MAX_DIRECT_COLS,
) -> PcaModel | tuple[PcaModel, PcaModel]:
    """Leading k singular triples of the preprocessed matrix.

    `both` gives the exact and the randomized model.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    # a sparse matrix stays sparse: its means and scales are applied inside the products
    matrix, row_stats = prepare_sparse(a, preprocess, weights) if isinstance(a, CooMatrix) else prepare(a, preprocess, weights)
    meta = {"n": a.n_cols, "preprocess": preprocess, "seed": seed}
    models = []
    if method != "randomized":
        svd = exact_svd(matrix, k, max_direct_cols, seed)
        models.append(_model(svd, matrix, row_stats, {**meta, "method": "exact"}))
    if method != "exact":
        svd = randomized_svd(matrix, k, oversample, power_iters, seed)
        models.append(_model(svd, matrix, row_stats, {**meta, "method": "randomized"}))
    return tuple(models) if method == "both" else models[0]


def compare(exact: PcaModel, randomized: PcaModel) -> DataFrame:
    """(comp, s_exact, s_rand, rel_diff)."""
    left = exact.s.withColumnRenamed("s", "s_exact")
    both = left.join(randomized.s.withColumnRenamed("s", "s_rand"), "comp")
    diff = F.abs(F.col("s_rand") - F.col("s_exact")) / F.col("s_exact")
    return both.select("comp", "s_exact", "s_rand", diff.alias("rel_diff"))


def factors_from_pair(left: TallMatrix, right: np.ndarray) -> TruncatedSvd:
    """SVD of left @ right with left an m x k table of orthonormal columns and right k x n."""
    from tallmat.operators.products import local_rows, times
    from tallmat.operators.svd import sign_fix

    w, s, vt = np.linalg.svd(right, full_matrices=False)
    signs = sign_fix(vt.T)
    return TruncatedSvd(
        times(left, w * signs), s, local_rows(left.df.sparkSession, vt.T * signs)
    )
