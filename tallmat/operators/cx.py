"""Leverage scores of a sparse matrix, and the CX decomposition built on them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix, TallMatrix
from tallmat.functions import arrays
from tallmat.operators import batches as codec
from tallmat.operators.fold import MatrixSum, check_local, fits_locally
from tallmat.operators.joined import JoinedMatrix
from tallmat.operators.svd import TruncatedSvd, all_ids, randomized_svd, right, with_rows
from tallmat.operators.tsqr import tsqr
from tallmat.session import cut_lineage

# Columns per bucket when draws are located in the cumulated probabilities.
BUCKET = 4096
# Draws located in one task.
DRAWS = 1 << 16


def leverage(factor: TallMatrix, rank: int) -> DataFrame:
    """(row_id, p): squared row norm of a factor with orthonormal columns, over rank."""
    return factor.df.select("row_id", (arrays.total_squares(F.col("v")) / rank).alias("p"))


@dataclass
class CxScores:
    """s(comp, s), row_lev(row_id, p), col_lev(col_id, p). Absent ids have score 0."""

    s: DataFrame
    row_lev: DataFrame
    col_lev: DataFrame
    svd: TruncatedSvd | None = None

    def dense_rows(self, row_ids: DataFrame) -> DataFrame:
        """row_lev for every id in `row_ids(row_id)`, 0 where the row has no entry."""
        joined = row_ids.select("row_id").join(self.row_lev, "row_id", "left")
        return joined.select("row_id", F.coalesce("p", F.lit(0.0)).alias("p"))

    def dense_cols(self, col_ids: DataFrame) -> DataFrame:
        joined = col_ids.select("col_id").join(self.col_lev, "col_id", "left")
        return joined.select("col_id", F.coalesce("p", F.lit(0.0)).alias("p"))

    def save(self, path: str) -> None:
        for part in ("s", "row_lev", "col_lev"):
            getattr(self, part).write.parquet(f"{path}/{part}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CxScores:
        return cls(*[spark.read.parquet(f"{path}/{part}") for part in ("s", "row_lev", "col_lev")])


def cx_scores(
    a: CooMatrix, rank: int, slack: int, iters: int, seed: int = 0, basis: str = "auto"
) -> CxScores:
    """Row and column leverage probabilities from a randomized SVD of width rank + slack.

    They add up to 1, or to r / rank where the matrix has only r < rank components.
    """
    svd = randomized_svd(a, rank, slack, iters, seed, basis)
    spark = a.df.sparkSession
    s = spark.createDataFrame([(i, float(x)) for i, x in enumerate(svd.s)], "comp BIGINT, s DOUBLE")
    col_lev = leverage(svd.v, rank).withColumnRenamed("row_id", "col_id")
    return CxScores(s, leverage(svd.u, rank), col_lev, svd)


def top_columns(col_lev: DataFrame, c: int) -> DataFrame:
    """(col_id, p, pos) of the c columns with the highest score; ties to the smaller id."""
    # nine digits of each score, however small: rounding makes exact ties differ in the last bits
    power = F.floor(F.log10(F.col("p") * (1 + 1e-10)))
    digits = F.round(F.col("p") / F.pow(F.lit(10.0), power), 9)
    ranking = [F.desc_nulls_last(power), F.desc_nulls_last(digits), F.col("col_id")]
    best = col_lev.orderBy(*ranking).limit(c)
    order = Window.orderBy(*ranking)
    return best.withColumn("pos", F.row_number().over(order).cast("bigint") - 1)


def sample_columns(col_lev: DataFrame, c: int, seed: int) -> DataFrame:
    """(pos, col_id, p, scale): c draws with replacement, column j with probability p_j.

    `scale` is 1 / sqrt(c p_j). The cumulated probabilities are built per bucket of
    column ids; only one sum per bucket reaches the driver. In a bucket draws and columns
    are merged in the order of the cumulated mass, so no draw is compared with a column
    it does not hit. Draws of a bucket with many are dealt over copies of its columns.
    """
    scored = col_lev.where(F.col("p") > 0).withColumn("bucket", F.floor(F.col("col_id") / BUCKET))
    sums = scored.groupBy("bucket").agg(F.sum("p").alias("mass")).orderBy("bucket").toArrow()
    check_local(sums.num_rows, 1)
    spark = col_lev.sparkSession
    if not sums.num_rows:
        raise ValueError("no column has a positive score")
    buckets = sums.column("bucket").to_numpy()
    ends = np.cumsum(sums.column("mass").to_numpy())
    draws = np.random.default_rng(seed).random(c) * ends[-1]
    at = np.minimum(np.searchsorted(ends, draws, side="right"), len(ends) - 1)
    copies = -(-np.bincount(at, minlength=len(ends)) // DRAWS)
    table = {
        "bucket": buckets[at],
        "copy": np.arange(c) % copies[at],
        "at": draws - np.concatenate([[0.0], ends[:-1]])[at],
        "pos": np.arange(c, dtype=np.int64),
    }
    drawn = spark.createDataFrame(pa.table(table))
    fans = spark.createDataFrame(pa.table({"bucket": buckets, "copies": copies})).where("copies > 0")

    # a bucket holds at most BUCKET columns
    before = Window.partitionBy("bucket").orderBy("col_id").rowsBetween(Window.unboundedPreceding, -1)
    spans = scored.withColumn("at", F.coalesce(F.sum("p").over(before), F.lit(0.0)))
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")
    spans = spans.join(fans, "bucket").select("bucket", copy, "at", F.struct("col_id", "p").alias("span"))
    # a column begins at its mass, so it stands before the draws there
    both = spans.unionByName(drawn, allowMissingColumns=True)
    so_far = Window.partitionBy("bucket", "copy").orderBy("at", F.col("pos").asc_nulls_first(), F.col("span.col_id"))
    hit = both.withColumn("span", F.last("span", ignorenulls=True).over(so_far)).where("pos IS NOT NULL")
    scale = 1.0 / F.sqrt(F.lit(float(c)) * F.col("span.p"))
    return hit.select("pos", "span.col_id", "span.p", scale.alias("scale"))


def chosen_columns(a: CooMatrix, chosen: DataFrame, c: int, scaled: bool = False) -> CooMatrix:
    """C = A[:, chosen(col_id, pos)], with each column times its `scale` if asked."""
    if not scaled:
        return a.gather(chosen, c)
    picked = a.df.join(chosen.select("col_id", "pos", "scale"), "col_id")
    val = F.col("val") * F.col("scale")
    return CooMatrix(picked.select("row_id", F.col("pos").alias("col_id"), val.alias("val")), c, True)


def _gram_rows(a: CooMatrix, chosen: DataFrame, c: int) -> TallMatrix:
    """A'C as a table of n rows; only the c chosen ids visit the driver."""
    n = a.n_cols
    ids = chosen.orderBy("pos").toArrow().column("col_id").to_numpy()
    distinct, place = np.unique(ids, return_inverse=True)

    def local(batches):
        acc = None
        where = np.full(n, -1)
        where[distinct] = np.arange(len(distinct))
        for piece in (p for batch in batches for p in codec.pieces(batch, len(distinct))):
            rows, cols, vals = codec.sparse_block(piece)
            picked = where[cols] >= 0
            x = np.zeros((piece.num_rows, len(distinct)))
            x[rows[picked], where[cols[picked]]] = vals[picked]
            acc = np.zeros((n, len(distinct))) if acc is None else acc
            for j in range(len(distinct)):
                acc[:, j] += np.bincount(cols, vals * x[rows, j], minlength=n)
        return acc if acc is None else acc[:, place]

    return TallMatrix(MatrixSum(a.sparse_rows(), local, n, c).to_rows(), c)


@dataclass
class CxFit:
    """x(row_id = column of A, v[c]) with A ~ C X, and relative_error(val)."""

    x: TallMatrix
    relative_error: DataFrame


def fit_x(a: CooMatrix, chosen: DataFrame, c: int, basis: str = "auto") -> CxFit:
    """X = argmin ||A - C X|| for C = A[:, chosen(col_id, pos)]; columns may be dependent.

    C'A is a set of rows of A'A, so while n x c values fit a task it takes one pass;
    beyond that it is a join of A with C.
    """
    columns = chosen_columns(a, chosen, c)
    inverse = np.linalg.pinv(tsqr(columns).r)
    if basis == "auto":
        basis = "local" if fits_locally(a.n_cols, c) else "table"
    if basis == "local":
        correlation = _gram_rows(a, chosen, c)
    else:
        joined = JoinedMatrix(a)
        shared = joined.transpose_times(columns.to_tall())
        # columns of A that share no row with C have coefficients 0, as in the local case
        filled = with_rows(shared, all_ids(a.df.sparkSession, a.n_cols))
        correlation = TallMatrix(cut_lineage(filled.df), c)
        joined.release()
    x = right(correlation, inverse @ inverse.T)
    # C X is a projection of A, so ||A - CX||^2 = ||A||^2 - <C'A, X>
    both = correlation.df.withColumnRenamed("v", "b").join(x.df, "row_id")
    dot = arrays.total(F.zip_with("b", "v", lambda p, q: p * q))
    explained = both.agg(F.sum(dot).alias("explained")).first().explained or 0.0
    norm2 = F.sum(F.col("val") * F.col("val"))
    rest = F.greatest(norm2 - explained, F.lit(0.0)) / norm2
    return CxFit(x, a.df.agg(F.sqrt(rest).alias("val")))
