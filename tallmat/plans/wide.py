"""Queries over wide and centered sparse matrices, and over bases narrower than the matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix
from tallmat.operators import cx, pairs, panels, pca, products, svd
from tallmat.operators.blocked import BlockedMatrix
from tallmat.operators.centered import prepare_sparse
from tallmat.operators.products import local_rows
from tallmat.plans import fixtures as fx
from tallmat.plans.factorizations import _REGRESSION, _eigen_sql, _regression, _singular_query
from tallmat.plans.products import _gram_product_sql, factor, factor_sql
from tallmat.plans.registry import long, query, rounded, sql_round

# -- dense, more columns than rows -------------------------------------------------


def supp_order(spark, sf) -> CooMatrix:
    """Quantity per supplier and order."""
    entries = fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("row_id"), F.col("l_orderkey").alias("col_id"), F.col("l_quantity").alias("val")
    )
    width = fx.table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    return CooMatrix(entries, width)


# the rows are few, so the oracle takes the Gram matrix of the transposed matrix
_SUPP_ORDER = """WITH RECURSIVE so AS MATERIALIZED (
  SELECT l_suppkey AS row_id, l_orderkey AS col_id, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2),
flipped AS MATERIALIZED (SELECT col_id AS row_id, row_id AS col_id, val FROM so)"""


@query(
    "fac3_wide_leading_value",
    f"""{_SUPP_ORDER},
{fx.gram_sql("g", "flipped")},
{fx.top_eigen_sql("g", 1)}
SELECT 0::BIGINT AS comp, {sql_round("sqrt(lam)", 1, 5)} AS s FROM l0""",
)
def fac3_wide(spark, sf):
    s = svd.exact_svd(supp_order(spark, sf).to_tall(), 1).s
    return rounded(spark.createDataFrame([(0, float(s[0]))], "comp BIGINT, s DOUBLE"), 1, 5, "s")


@query(
    "fac7_wide_squared_error",
    f"""{_SUPP_ORDER},
{fx.gram_sql("g", "flipped")},
{fx.top_eigen_sql("g", 1)}
SELECT {sql_round("(SELECT sum(val * val) FROM so) - lam", 1e6)} AS val FROM l0""",
)
def fac7_wide_error(spark, sf):
    return rounded(pca.pca(supp_order(spark, sf).to_tall(), 1, "none").squared_error(), 1e6)


@query(
    "prd8_gram_entries_order_part",
    f"""WITH m AS MATERIALIZED (
  SELECT l_orderkey AS row_id, l_partkey AS col_id, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2),
{fx.gram_sql("g", "m")}
SELECT i AS row_id, j AS col_id, {sql_round("g")} AS val FROM g""",
)
def prd8_entries(spark, sf):
    entries = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id"), F.col("l_quantity").alias("val")
    )
    width = fx.table(spark, sf, "part").agg(F.max("p_partkey")).first()[0] + 1
    return long(pairs.gram_entries(CooMatrix(entries, width)))


@query(
    "prd8_gram_entries_long_rows",
    f"""WITH m AS MATERIALIZED (
  SELECT s_nationkey AS row_id, l_partkey AS col_id, sum(l_quantity) AS val
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
{fx.gram_sql("g", "m")}
SELECT i AS row_id, count(*) AS entries, {sql_round("sum(g)")} AS val, {sql_round("max(g)")} AS largest
FROM g GROUP BY i""",
)
def prd8_entries_long(spark, sf):
    # 25 rows that hold nearly every part; the product is nearly full, so its rows are summed up
    suppliers = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    entries = fx.table(spark, sf, "lineitem").join(suppliers, "l_suppkey").select(
        F.col("s_nationkey").alias("row_id"), F.col("l_partkey").alias("col_id"), F.col("l_quantity").alias("val")
    )
    width = fx.table(spark, sf, "part").agg(F.max("p_partkey")).first()[0] + 1
    g = pairs.gram_entries(CooMatrix(entries, width), segment=256).df
    rows = g.groupBy("row_id").agg(F.count("*").alias("entries"), F.sum("val").alias("val"), F.max("val").alias("largest"))
    return rounded(rows, 1.0, 6, "val", "largest")


@query("prd2_blocked_gram_times", _gram_product_sql("emb", 3, 1.0))
def prd2_blocked(spark, sf):
    # 64 columns in blocks of 10, rows in buckets of 100
    a = BlockedMatrix.from_tall(fx.emb(spark, sf), 10, 100)
    return long(a.gram_times(local_rows(spark, factor(fx.EMBEDDING, 3))))


# -- R in panels of columns, Gram matrix in pairs of blocks --------------------------


_EMB_GRAM = f"""{fx.with_matrices("emb")},
{fx.gram_sql("g", "emb")}
SELECT i AS row_id, j AS col_id, {sql_round("g")} AS val FROM g"""


@query("fac1_panel_qr_gram", _EMB_GRAM)
def fac1_panels(spark, sf):
    """R'R of the embeddings, R from panels of 24 of the 64 columns."""
    r = panels.panel_qr(fx.emb(spark, sf), 24).r
    return long(products.gram(r))


@query("prd8_blocked_gram", _EMB_GRAM)
def prd8_blocked(spark, sf):
    return long(BlockedMatrix.from_tall(fx.emb(spark, sf), 10, 100).gram())


@query(
    "fac2_panel_qr_orthonormal",
    f"""{fx.with_matrices("order4")},
c AS (SELECT DISTINCT col_id AS i FROM order4)
SELECT a.i AS row_id, b.i AS col_id, CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0 END AS val FROM c a CROSS JOIN c b""",
)
def fac2_panels(spark, sf):
    q, _ = panels.thin_qr(fx.order4(spark, sf), 3)
    return long(products.gram(q), 1, 10)


@query(
    "fac18_least_squares_panels",
    f"""WITH {_REGRESSION},
t AS (SELECT x, 0::BIGINT AS target, y0 AS y FROM o UNION ALL SELECT x, 1, y1 FROM o)
SELECT target, {sql_round("regr_slope(y, x)", 1, 7)} AS slope,
       {sql_round("regr_intercept(y, x)")} AS intercept,
       {sql_round("sqrt(regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x))", 1000)} AS residual
FROM t GROUP BY 1""",
)
def fac18_panels(spark, sf):
    """A panel per column: the second one is what the first one leaves."""
    x, residual = panels.least_squares(_regression(spark, sf), 2, 1)
    rows = [(t, float(x[0, t]), float(x[1, t]), float(residual[t])) for t in range(2)]
    df = spark.createDataFrame(rows, "target BIGINT, slope DOUBLE, intercept DOUBLE, residual DOUBLE")
    return rounded(rounded(rounded(df, 1, 7, "slope"), 1, 6, "intercept"), 1000, 6, "residual")


@query(
    "fac19_ridge_panels",
    f"""WITH {_REGRESSION},
e AS (SELECT sum(x * x) + 10 AS a, sum(x) AS b, count(*) + 10 AS c, sum(x * y0) AS p, sum(y0) AS q FROM o)
SELECT {sql_round("(c * p - b * q) / (a * c - b * b)", 1, 7)} AS slope,
       {sql_round("(a * q - b * p) / (a * c - b * b)", 1, 7)} AS intercept FROM e""",
)
def fac19_panels(spark, sf):
    x = panels.ridge(_regression(spark, sf).col_slice(0, 3), 1, [10.0], 1)[0]
    df = spark.createDataFrame([(float(x[0, 0]), float(x[1, 0]))], "slope DOUBLE, intercept DOUBLE")
    return rounded(df, 1, 7, "slope", "intercept")


# -- sparse, centered without filling ------------------------------------------------


_SPARSE_CENTERED = """,
cols AS (SELECT unnest(range((SELECT max(s_suppkey) + 1 FROM supplier))) AS col_id),
d AS MATERIALIZED (
  SELECT r.row_id, c.col_id, coalesce(p.val, 0.0) AS val
  FROM (SELECT DISTINCT row_id FROM part_supp) r CROSS JOIN cols c
  LEFT JOIN part_supp p ON p.row_id = r.row_id AND p.col_id = c.col_id),
a AS MATERIALIZED (SELECT row_id, col_id, val - avg(val) OVER (PARTITION BY row_id) AS val FROM d)"""

_STANDARDIZED = f"""{_SPARSE_CENTERED},
z AS MATERIALIZED (
  SELECT row_id, col_id, val / (CASE WHEN stddev_samp(val) OVER (PARTITION BY row_id) < 1e-4 THEN 1.0
    ELSE stddev_samp(val) OVER (PARTITION BY row_id) END) AS val FROM a)"""


def _sparse_products_sql(source: str, matrix: str) -> str:
    return f"""{fx.with_matrices("part_supp")}{source},
{factor_sql("SELECT col_id AS i FROM cols", 2)},
ab AS MATERIALIZED (
  SELECT a.row_id, b.j AS col_id, sum(a.val * b.b) AS val FROM {matrix} a JOIN b ON a.col_id = b.i GROUP BY 1, 2)
SELECT a.col_id AS row_id, ab.col_id, {sql_round("sum(a.val * ab.val)", 1000)} AS val
FROM {matrix} a JOIN ab ON a.row_id = ab.row_id GROUP BY 1, 2"""


@query("fac7_pca_sparse_centered", _singular_query("part_supp", 2, _SPARSE_CENTERED))
def fac7_sparse(spark, sf):
    return rounded(pca.pca(fx.part_supp(spark, sf), 2).s, 1, 6, "s")


@query("prd2_centered_sparse", _sparse_products_sql(_SPARSE_CENTERED, "a"))
def prd2_centered(spark, sf):
    a, _ = prepare_sparse(fx.part_supp(spark, sf), "centerOverAllObservations")
    return long(local_rows(spark, products.gram_times_local(a, factor(a.n_cols, 2))), 1000)


@query("prd2_standardized_sparse_joined", _sparse_products_sql(_STANDARDIZED, "z"))
def prd2_standardized(spark, sf):
    a, _ = prepare_sparse(fx.part_supp(spark, sf), "standardizeEach")
    return long(a.placed().gram_times(local_rows(spark, factor(a.n_cols, 2))), 1000)


@query(
    "pre6_sparse_row_stats",
    f"""{fx.with_matrices("part_supp", "latitude")}{_SPARSE_CENTERED}
SELECT row_id, {sql_round("avg(val)")} AS mean, {sql_round("stddev_samp(val)")} AS std FROM d GROUP BY row_id""",
)
def pre6_sparse(spark, sf):
    _, row_stats = prepare_sparse(fx.part_supp(spark, sf), "standardizeEach")
    return rounded(row_stats.select("row_id", "mean", "std"), 1, 6, "mean", "std")


# -- a merge that the built-in sum does not reach ---------------------------------------


@query(
    "prd0_fold_merges_blocks",
    f"""{fx.with_matrices("emb")},
g AS MATERIALIZED (
  SELECT a.col_id AS i, b.col_id AS j, sum(a.val * b.val) AS g FROM emb a JOIN emb b ON a.row_id = b.row_id GROUP BY 1, 2)
SELECT i AS row_id, j + 64 * t.t AS col_id, {sql_round("g * (1 + t.t)")} AS val
FROM g CROSS JOIN (SELECT unnest(range(2)) AS t) t""",
)
def prd0_blocks(spark, sf):
    # 64 x 128 sums are above what the built-in aggregate takes
    a = fx.emb(spark, sf)
    twice = np.hstack([np.eye(64), 2 * np.eye(64)])
    return long(products.gram_times(a, twice))


# -- bases narrower than the matrix: wrong without the iteration ---------------------------


@query("fac5_randomized_narrow", _singular_query("part_nation", 1))
def fac5_narrow(spark, sf):
    return rounded(pca.pca(fx.part_nation(spark, sf), 1, "none", "randomized", oversample=2).s, 1, 6, "s")


@query(
    "fac6_exact_and_randomized_narrow",
    f"""{_eigen_sql("part_nation", 1)}
SELECT 0::BIGINT AS comp, {sql_round("sqrt(lam)")} AS s_exact, {sql_round("sqrt(lam)")} AS s_rand, 0.0::DOUBLE AS rel_diff FROM l0""",
)
def fac6_narrow(spark, sf):
    both = pca.compare(*pca.pca(fx.part_nation(spark, sf), 1, "none", "both", oversample=2))
    return rounded(both, 1, 6, "s_exact", "s_rand", "rel_diff")


def _narrow_scores(spark, sf) -> cx.CxScores:
    return cx.cx_scores(fx.part_nation(spark, sf).to_coo(), 1, 2, 12)


@query("fac8_cx_singular_value_narrow", _singular_query("part_nation", 1))
def fac8_narrow(spark, sf):
    return rounded(_narrow_scores(spark, sf).s, 1, 6, "s")


@query(
    "fac9_row_leverage_narrow",
    f"""{_eigen_sql("part_nation", 1)}
SELECT a.row_id, {sql_round("pow(sum(a.val * v0.x), 2) / any_value(l0.lam)", 1, 8)} AS p
FROM part_nation a JOIN v0 ON v0.i = a.col_id CROSS JOIN l0 GROUP BY 1 HAVING max(abs(a.val)) > 0""",
)
def fac9_narrow(spark, sf):
    return rounded(_narrow_scores(spark, sf).row_lev, 1, 8, "p")


@query(
    "fac10_column_leverage_narrow",
    f"""{_eigen_sql("part_nation", 1)}
SELECT i AS col_id, {sql_round("x * x", 1, 8)} AS p FROM v0""",
)
def fac10_narrow(spark, sf):
    return rounded(_narrow_scores(spark, sf).col_lev, 1, 8, "p")


@query(
    "fac11_cx_joined_narrow",
    f"""{_eigen_sql("part_nation", 1)}
SELECT i AS col_id, {sql_round("x * x", 1, 8)} AS p FROM v0""",
)
def fac11_narrow(spark, sf):
    """Column leverage with the basis as a table."""
    scores = cx.cx_scores(fx.part_nation(spark, sf).to_coo(), 1, 2, 8, basis="table")
    return rounded(scores.col_lev, 1, 8, "p")


# -- materialization ---------------------------------------------------------------------


@query(
    "mat2_materialize",
    f"""{fx.with_matrices("user_event")}
SELECT count(DISTINCT row_id) AS n_rows, {sql_round("sum(val)", 1000)} AS total FROM user_event""",
)
def mat2(spark, sf):
    held = fx.user_event(spark, sf).keep()
    n = held.count()
    total = held.df.agg(F.sum(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)).alias("total"))
    return rounded(total.select(F.lit(n).cast("bigint").alias("n_rows"), "total"), 1000, 6, "total")


@query(
    "mat4_collect",
    f"""{fx.with_matrices("user_event")}
SELECT dense_rank() OVER (ORDER BY row_id) - 1 AS row_id, col_id, {sql_round("val")} AS val FROM user_event""",
)
def mat4(spark, sf):
    # rows of the local array are in the order of the row ids
    return long(local_rows(spark, fx.user_event(spark, sf).to_numpy()))
