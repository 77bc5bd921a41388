"""Queries over the matrix products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallmat.frames import TallMatrix
from tallmat.operators import products
from tallmat.operators.joined import JoinedMatrix
from tallmat.operators.nnls import solve_nnls
from tallmat.plans import fixtures as fx
from tallmat.plans.registry import long, query, sql_round


def factor(n: int, k: int) -> np.ndarray:
    """A fixed n x k right-hand side with entries (3i + 5j) mod 7 - 3."""
    i, j = np.arange(n)[:, None], np.arange(k)[None, :]
    return ((3 * i + 5 * j) % 7 - 3).astype(float)


def factor_sql(cols: str, k: int) -> str:
    return f"""b AS MATERIALIZED (
  SELECT c.i, j.j, ((3 * c.i + 5 * j.j) % 7 - 3)::DOUBLE AS b
  FROM ({cols}) c CROSS JOIN (SELECT unnest(range({k})) AS j) j)"""


def _product_sql(matrix: str, k: int) -> str:
    return f"""{fx.with_matrices(matrix)},
{factor_sql(f"SELECT DISTINCT col_id AS i FROM {matrix}", k)},
ab AS MATERIALIZED (
  SELECT a.row_id, b.j AS col_id, sum(a.val * b.b) AS val
  FROM {matrix} a JOIN b ON a.col_id = b.i GROUP BY 1, 2)"""


def _gram_product_sql(matrix: str, k: int, scale: float, factor: str = "1") -> str:
    return f"""{_product_sql(matrix, k)}
SELECT a.col_id AS row_id, ab.col_id, {sql_round(f"sum(a.val * ab.val) * {factor}", scale)} AS val
FROM {matrix} a JOIN ab ON a.row_id = ab.row_id GROUP BY 1, 2"""


@query(
    "prd0_fold_gram_wide_blocks",
    f"""{fx.with_matrices("emb")}
SELECT a.col_id AS row_id, b.col_id, {sql_round("sum(a.val * b.val)")} AS val
FROM emb a JOIN emb b ON a.row_id = b.row_id GROUP BY 1, 2""",
)
def prd0(spark, sf):
    # the Gram matrix as A'A I, through the merge of partial blocks
    a = fx.emb(spark, sf)
    return long(products.gram_times(a, np.eye(a.n_cols)))


@query(
    "prd1_times_local",
    f"""{_product_sql("emb", 3)}
SELECT row_id, col_id, {sql_round("val")} AS val FROM ab""",
)
def prd1(spark, sf):
    return long(products.times(fx.emb(spark, sf), factor(fx.EMBEDDING, 3)))


@query(
    "prd1_times_local_sparse",
    f"""{_product_sql("part_supp", 3)}
SELECT row_id, col_id, {sql_round("val")} AS val FROM ab""",
)
def prd1_sparse(spark, sf):
    a = fx.part_supp(spark, sf)
    return long(products.times(a, factor(a.n_cols, 3)))


@query("prd2_gram_times", _gram_product_sql("part_supp", 3, 1000))
def prd2(spark, sf):
    a = fx.part_supp(spark, sf)
    return long(products.gram_times(a, factor(a.n_cols, 3)), 1000)


@query("prd2_gram_times_joined", _gram_product_sql("part_supp", 3, 1000))
def prd2_joined(spark, sf):
    a = fx.part_supp(spark, sf)
    b = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda j: _factor_column(j))
    rhs = a.df.select(F.col("col_id").alias("row_id")).distinct()
    rhs = TallMatrix(rhs.select("row_id", b.alias("v")), 3)
    return long(JoinedMatrix(a).gram_times(rhs), 1000)


def _factor_column(j):
    return ((F.col("row_id") * 3 + j * 5) % 7 - 3).cast("double")


_M = "(1.0 / (SELECT count(DISTINCT row_id) FROM {}))"


@query(
    "prd3_covariance_times",
    _gram_product_sql("part_nation", 3, 1, _M.format("part_nation")),
)
def prd3(spark, sf):
    a = fx.part_nation(spark, sf)
    return long(products.covariance_times(a, factor(fx.NATIONS, 3), a.count()))


@query(
    "prd4_covariance_times_sparse",
    _gram_product_sql("part_supp", 4, 1, _M.format("part_supp")),
)
def prd4(spark, sf):
    a = fx.part_supp(spark, sf)
    rows = a.df.agg(F.count_distinct("row_id")).first()[0]
    return long(products.covariance_times(a, factor(a.n_cols, 4), rows))


@query("prd5_gram_times_vector", _gram_product_sql("supp_month", 1, 1e6))
def prd5(spark, sf):
    return long(products.gram_times(fx.supp_month(spark, sf), factor(fx.MONTHS, 1)), 1e6)


def part_totals(spark, sf) -> TallMatrix:
    lines = fx.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("row_id"))
    sums = lines.agg(F.sum("l_discount").alias("d"), F.sum("l_tax").alias("t"))
    return TallMatrix.from_columns(sums, ["d", "t"])


_PART_TOTALS = """t AS MATERIALIZED (
  SELECT l_partkey AS row_id, c.col_id,
         sum(CASE c.col_id WHEN 0 THEN l_discount ELSE l_tax END) AS val
  FROM lineitem CROSS JOIN (SELECT unnest(range(2)) AS col_id) c GROUP BY 1, 2)"""


def _cross_sql(matrix: str, row: str, col: str) -> str:
    return f"""{fx.with_matrices(matrix)},
{_PART_TOTALS}
SELECT {row} AS row_id, {col} AS col_id, {sql_round("sum(a.val * t.val)")} AS val
FROM {matrix} a JOIN t ON a.row_id = t.row_id GROUP BY 1, 2"""


@query("prd6_transpose_times", _cross_sql("part_nation", "a.col_id", "t.col_id"))
def prd6(spark, sf):
    return long(products.transpose_times(fx.part_nation(spark, sf), part_totals(spark, sf)))


@query("prd6_transpose_times_joined", _cross_sql("part_supp", "a.col_id", "t.col_id"))
def prd6_joined(spark, sf):
    return long(JoinedMatrix(fx.part_supp(spark, sf)).transpose_times(part_totals(spark, sf)))


@query("prd7_left_times", _cross_sql("part_nation", "t.col_id", "a.col_id"))
def prd7(spark, sf):
    return long(products.left_times(part_totals(spark, sf), fx.part_nation(spark, sf)))


def _gram_query(matrix: str, scale: float) -> str:
    return f"""{fx.with_matrices(matrix)},
{fx.gram_sql("g", matrix)}
SELECT i AS row_id, j AS col_id, {sql_round("g", scale)} AS val FROM g"""


@query("prd8_gram", _gram_query("part_nation", 1000))
def prd8(spark, sf):
    return long(products.gram(fx.part_nation(spark, sf)), 1000)


@query(
    "prd8_gram_sparse",
    f"""{fx.with_matrices("part_supp")},
{fx.gram_sql("g", "part_supp")},
n AS (SELECT unnest(range((SELECT max(s_suppkey) + 1 FROM supplier))) AS i)
SELECT a.i AS row_id, b.i AS col_id, {sql_round("coalesce(g.g, 0)", 1000)} AS val
FROM n a CROSS JOIN n b LEFT JOIN g ON g.i = a.i AND g.j = b.i""",
)
def prd8_sparse(spark, sf):
    return long(products.gram(fx.part_supp(spark, sf)), 1000)


@query(
    "prd9_residual_correlation",
    f"""{fx.with_matrices("part_nation")},
{fx.gram_sql("g", "part_nation")},
h AS (SELECT k.j, CASE WHEN d.g > 0 THEN greatest(k.g / d.g, 0) ELSE 0 END AS h
      FROM g k JOIN g d ON d.i = 9 AND d.j = 9 WHERE k.i = 9)
SELECT g.i AS row_id, g.j AS col_id, {sql_round("g.g - h.h * k.g", 1000)} AS val
FROM g JOIN h ON h.j = g.i JOIN g k ON k.i = 9 AND k.j = g.j""",
)
def prd9(spark, sf):
    g = products.gram_local(fx.part_nation(spark, sf))
    h = solve_nnls(g[[9]][:, [9]], g[[9], :].T)[0].T
    return long(products.local_rows(spark, products.residual_correlation(g, [9], h)), 1000)
