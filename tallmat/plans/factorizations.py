"""Queries over QR, least squares, PCA, NMF and CX."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix, TallMatrix
from tallmat.operators import cx, nnls, pca, preprocess, products, svd, tsqr
from tallmat.operators.nmf import load_nmf, nmf
from tallmat.plans import fixtures as fx
from tallmat.plans.registry import long, query, rounded, sql_round
from tallmat.session import scratch_path

COMP = "comp BIGINT, s DOUBLE"


def _values(spark, s: np.ndarray):
    return rounded(spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], COMP), 1, 6, "s")


def _vectors(v: TallMatrix, digits: int = 6):
    """(comp, col_id, val) from rows of right vectors."""
    df = v.entries().select(F.col("col_id").alias("comp"), F.col("row_id").alias("col_id"), "val")
    return rounded(df, 1.0, digits)


def _eigen_sql(matrix: str, k: int, source: str | None = None) -> str:
    return f"""{fx.with_matrices(matrix)}{source or ""},
{fx.gram_sql("g", "a" if source else matrix)},
{fx.top_eigen_sql("g", k)}"""


def _singular_query(matrix: str, k: int, source: str | None = None) -> str:
    return f"""{_eigen_sql(matrix, k, source)}
SELECT comp, {sql_round("s")} AS s FROM ({fx.singular_sql(k)})"""


def _vector_query(matrix: str, k: int, digits: int = 6) -> str:
    return f"""{_eigen_sql(matrix, k)}
SELECT comp, i AS col_id, {sql_round("x", 1, digits)} AS val FROM ({fx.vectors_sql(k)})"""


# -- QR -------------------------------------------------------------------


@query(
    "fac1_tsqr_gram",
    f"""{fx.with_matrices("order4")},
{fx.gram_sql("g", "order4")}
SELECT g.i AS row_id, g.j AS col_id, {sql_round("g.g / sqrt(a.g * b.g)")} AS val
FROM g JOIN g a ON a.i = g.i AND a.j = g.i JOIN g b ON b.i = g.j AND b.j = g.j""",
)
def fac1(spark, sf):
    r = tsqr.tsqr(fx.order4(spark, sf)).r
    unit = r / np.linalg.norm(r, axis=0)
    return long(products.local_rows(spark, unit.T @ unit))


@query(
    "fac1_tsqr_r",
    f"""{fx.with_matrices("order4")},
{fx.gram_sql("g", "order4")},
e AS (SELECT max(CASE WHEN i = 0 AND j = 0 THEN g END) AS a,
             max(CASE WHEN i = 0 AND j = 2 THEN g END) AS b,
             max(CASE WHEN i = 2 AND j = 2 THEN g END) AS c FROM g)
SELECT 0::BIGINT AS row_id, 0::BIGINT AS col_id, {sql_round("sqrt(a)")} AS val FROM e
UNION ALL SELECT 0, 1, {sql_round("b / sqrt(a)")} FROM e
UNION ALL SELECT 1, 0, 0.0 FROM e
UNION ALL SELECT 1, 1, {sql_round("sqrt(c - b * b / a)")} FROM e""",
)
def fac1_r(spark, sf):
    return long(products.local_rows(spark, tsqr.tsqr(fx.order4(spark, sf).gather([0, 2])).r))


@query(
    "fac1_tsqr_norms",
    f"""{fx.with_matrices("order4")}
SELECT col_id, {sql_round("sum(abs(val))", 1000)} AS val FROM order4 GROUP BY 1""",
)
def fac1_norms(spark, sf):
    norms = tsqr.tsqr(fx.order4(spark, sf)).col_l1
    return rounded(
        spark.createDataFrame([(j, float(x)) for j, x in enumerate(norms)], "col_id BIGINT, val DOUBLE"),
        1000,
    )


@query(
    "fac2_thin_qr_product",
    f"""{fx.with_matrices("order4")}
SELECT row_id, col_id, {sql_round("val", 1, 4)} AS val FROM order4""",
)
def fac2_product(spark, sf):
    q, r = tsqr.thin_qr(fx.order4(spark, sf).keep())
    return long(products.times(q, r), 1, 4)


@query(
    "fac2_thin_qr_orthonormal",
    f"""{fx.with_matrices("order4")},
c AS (SELECT DISTINCT col_id FROM order4)
SELECT a.col_id AS row_id, b.col_id, CASE WHEN a.col_id = b.col_id THEN 1.0::DOUBLE ELSE 0.0 END AS val
FROM c a CROSS JOIN c b""",
)
def fac2_orthonormal(spark, sf):
    q, _ = tsqr.thin_qr(fx.order4(spark, sf).keep())
    return long(products.gram(q), 1, 10)


# -- SVD and PCA ------------------------------------------------------------


@query("fac3_exact_singular_values", _singular_query("user_event", 3))
def fac3_values(spark, sf):
    return _values(spark, svd.exact_svd(fx.user_event(spark, sf), 3).s)


@query("fac3_exact_right_vectors", _vector_query("user_event", 3))
def fac3_vectors(spark, sf):
    return _vectors(svd.exact_svd(fx.user_event(spark, sf), 3).v)


@query("fac3_krylov_right_vectors", _vector_query("part_nation", 2))
def fac3_krylov(spark, sf):
    return _vectors(svd.exact_svd(fx.part_nation(spark, sf), 2, max_direct_cols=8).v)


@query("fac3_krylov_table_basis", _vector_query("user_event", 1))
def fac3_krylov_table(spark, sf):
    return _vectors(svd.krylov_svd(fx.user_event(spark, sf), 1, basis="table").v)


@query("fac4_low_rank_pair", _singular_query("user_event", 5))
def fac4(spark, sf):
    left, right = tsqr.thin_qr(fx.user_event(spark, sf))
    return _values(spark, pca.factors_from_pair(left, right).s)


@query(
    "fac4_left_factor_product",
    f"""{fx.with_matrices("user_event")}
SELECT row_id, col_id, {sql_round("val")} AS val FROM user_event""",
)
def fac4_product(spark, sf):
    left, right = tsqr.thin_qr(fx.user_event(spark, sf))
    f = pca.factors_from_pair(left, right)
    return long(products.times(f.u, f.s[:, None] * f.v.to_numpy().T))


@query("fac5_randomized_singular_values", _singular_query("user_event", 2))
def fac5(spark, sf):
    return rounded(
        pca.pca(fx.user_event(spark, sf), 2, "none", "randomized").s, 1, 6, "s"
    )


@query("fac5_randomized_table_basis", _singular_query("user_event", 2))
def fac5_tables(spark, sf):
    return _values(spark, svd.randomized_svd(fx.user_event(spark, sf), 2, 3, 1, basis="table").s)


@query(
    "fac6_exact_and_randomized",
    f"""{_eigen_sql("user_event", 2)}
SELECT comp, {sql_round("s")} AS s_exact, {sql_round("s")} AS s_rand, 0.0::DOUBLE AS rel_diff
FROM ({fx.singular_sql(2)})""",
)
def fac6(spark, sf):
    both = pca.compare(*pca.pca(fx.user_event(spark, sf), 2, "none", "both"))
    return rounded(both, 1, 6, "s_exact", "s_rand", "rel_diff")


@query("fac5_randomized_sparse", _singular_query("user_event", 2))
def fac5_sparse(spark, sf):
    a = fx.user_event(spark, sf).to_coo()
    return rounded(pca.pca(a, 2, "none", "randomized", oversample=3).s, 1, 6, "s")


_CENTERED = """,
a AS MATERIALIZED (
  SELECT row_id, col_id, val - avg(val) OVER (PARTITION BY row_id) AS val FROM user_event)"""


@query("fac7_pca_singular_values", _singular_query("user_event", 2, _CENTERED))
def fac7_values(spark, sf):
    return rounded(pca.pca(fx.user_event(spark, sf), 2).s, 1, 6, "s")


@query(
    "fac7_pca_scores",
    f"""{_eigen_sql("user_event", 2, _CENTERED)}
SELECT a.row_id, v.comp, {sql_round("sum(a.val * v.x)", 1, 4)} AS val
FROM a JOIN ({fx.vectors_sql(2)}) v ON v.i = a.col_id GROUP BY 1, 2""",
)
def fac7_scores(spark, sf):
    model = pca.pca(fx.user_event(spark, sf), 2)
    scores = products.times(model.u, np.diag(model.singular_values())).entries()
    return rounded(scores.withColumnRenamed("col_id", "comp"), 1, 4)


@query(
    "fac7_pca_squared_error",
    f"""{_eigen_sql("user_event", 1, _CENTERED)}
SELECT {sql_round("(SELECT sum(val * val) FROM a) - lam", 1e6)} AS val FROM l0""",
)
def fac7_error(spark, sf):
    return rounded(pca.pca(fx.user_event(spark, sf), 1).squared_error(), 1e6)


# -- CX -----------------------------------------------------------------------


def _nation_scores(spark, sf, a: CooMatrix | None = None) -> cx.CxScores:
    # rank + slack is the full width, so the randomized factor is the exact one
    a = a or fx.part_nation(spark, sf).to_coo()
    return cx.cx_scores(a, 2, fx.NATIONS - 2, 2)


_ROW_LEV = """SELECT a.row_id, sum(s.p) / 2 AS p FROM (
    SELECT a.row_id, v.comp, pow(sum(a.val * v.x), 2) / any_value(l.lam) AS p
    FROM {m} a JOIN ({v}) v ON v.i = a.col_id
    JOIN (SELECT 0 AS comp, lam FROM l0 UNION ALL SELECT 1, lam FROM l1) l ON l.comp = v.comp
    GROUP BY 1, 2) s JOIN (SELECT DISTINCT row_id FROM {m} WHERE val <> 0) a ON a.row_id = s.row_id
  GROUP BY 1"""
_COL_LEV = "SELECT i AS col_id, sum(x * x) / 2 AS p FROM ({v}) GROUP BY 1"


@query("fac8_cx_singular_values", _singular_query("part_nation", 2))
def fac8(spark, sf):
    return rounded(_nation_scores(spark, sf).s, 1, 6, "s")


@query(
    "fac9_row_leverage",
    f"""{_eigen_sql("part_nation", 2)}
SELECT row_id, {sql_round("p", 1, 8)} AS p
FROM ({_ROW_LEV.format(m="part_nation", v=fx.vectors_sql(2))})""",
)
def fac9(spark, sf):
    return rounded(_nation_scores(spark, sf).row_lev, 1, 8, "p")


@query(
    "fac10_column_leverage",
    f"""{_eigen_sql("part_nation", 2)}
SELECT col_id, {sql_round("p", 1, 8)} AS p FROM ({_COL_LEV.format(v=fx.vectors_sql(2))})""",
)
def fac10(spark, sf):
    return rounded(_nation_scores(spark, sf).col_lev, 1, 8, "p")


@query(
    "fac11_cx_job",
    f"""{_eigen_sql("user_event", 2)}
SELECT 's' AS part, comp AS id, {sql_round("s", 1000)} AS val FROM ({fx.singular_sql(2)})
UNION ALL SELECT 'row', row_id, {sql_round("p")}
  FROM ({_ROW_LEV.format(m="user_event", v=fx.vectors_sql(2))})
UNION ALL SELECT 'col', col_id, {sql_round("p")}
  FROM ({_COL_LEV.format(v=fx.vectors_sql(2))})""",
)
def fac11(spark, sf):
    scores = cx.cx_scores(fx.user_event(spark, sf).to_coo(), 2, 3, 3)

    def part(name, df, key, value, scale):
        picked = df.select(F.lit(name).alias("part"), F.col(key).alias("id"), F.col(value).alias("val"))
        return rounded(picked, scale)

    s = part("s", scores.s, "comp", "s", 1000)
    rows = part("row", scores.row_lev, "row_id", "p", 1)
    return s.unionAll(rows).unionAll(part("col", scores.col_lev, "col_id", "p", 1))


@query(
    "cx1_top_columns",
    f"""{_eigen_sql("part_nation", 2)}
SELECT col_id, row_number() OVER (ORDER BY round(p, 12) DESC, col_id) - 1 AS pos,
       {sql_round("p", 1, 8)} AS p
FROM ({_COL_LEV.format(v=fx.vectors_sql(2))}) ORDER BY pos LIMIT 4""",
)
def cx1(spark, sf):
    return rounded(cx.top_columns(_nation_scores(spark, sf).col_lev, 4), 1, 8, "p")


@query(
    "cx2_sampled_columns",
    f"""{fx.with_matrices("part_nation")}
SELECT 40::BIGINT AS draws, 40::BIGINT AS positions, true AS in_range, true AS scaled
FROM (SELECT count(*) FROM part_nation)""",
)
def cx2(spark, sf):
    drawn = cx.sample_columns(_nation_scores(spark, sf).col_lev, 40, seed=7)
    back = F.abs(F.col("scale") * F.col("scale") * 40 * F.col("p") - 1) < 1e-9
    return drawn.agg(
        F.count("*").alias("draws"),
        F.count_distinct("pos").alias("positions"),
        F.bool_and(F.col("col_id").between(0, fx.NATIONS - 1)).alias("in_range"),
        F.bool_and(back).alias("scaled"),
    )


def _with_chosen(spark, sf):
    """The sparse matrix, read once and kept, and its two best columns."""
    a = fx.part_nation(spark, sf).keep().to_coo()
    return a, cx.top_columns(_nation_scores(spark, sf, a).col_lev, 2)


_CHOSEN = f"""{_eigen_sql("part_nation", 2)},
k AS MATERIALIZED (
  SELECT col_id, row_number() OVER (ORDER BY round(p, 12) DESC, col_id) - 1 AS pos
  FROM ({_COL_LEV.format(v=fx.vectors_sql(2))}) ORDER BY pos LIMIT 2)"""


@query(
    "cx3_chosen_columns",
    f"""{_CHOSEN}
SELECT a.row_id, k.pos AS col_id, {sql_round("a.val")} AS val
FROM part_nation a JOIN k ON a.col_id = k.col_id WHERE a.val <> 0""",
)
def cx3(spark, sf):
    a, chosen = _with_chosen(spark, sf)
    return long(cx.chosen_columns(a, chosen, 2))


_FIT = f"""{_CHOSEN},
e AS MATERIALIZED (
  SELECT max(CASE WHEN p.pos = 0 AND q.pos = 0 THEN g.g END) AS a,
         max(CASE WHEN p.pos = 0 AND q.pos = 1 THEN g.g END) AS b,
         max(CASE WHEN p.pos = 1 AND q.pos = 1 THEN g.g END) AS c
  FROM g JOIN k p ON p.col_id = g.i JOIN k q ON q.col_id = g.j),
t AS MATERIALIZED (
  SELECT g.j AS col, max(CASE WHEN k.pos = 0 THEN g.g END) AS p,
         max(CASE WHEN k.pos = 1 THEN g.g END) AS q
  FROM g JOIN k ON k.col_id = g.i GROUP BY 1),
x AS MATERIALIZED (
  SELECT col, p, q, (e.c * p - e.b * q) / (e.a * e.c - e.b * e.b) AS x0,
         (e.a * q - e.b * p) / (e.a * e.c - e.b * e.b) AS x1 FROM t CROSS JOIN e)"""


@query(
    "cx4_fitted_x",
    f"""{_FIT}
SELECT col AS row_id, c.col_id, {sql_round("CASE c.col_id WHEN 0 THEN x0 ELSE x1 END")} AS val
FROM x CROSS JOIN (SELECT unnest(range(2)) AS col_id) c""",
)
def cx4_x(spark, sf):
    a, chosen = _with_chosen(spark, sf)
    return long(cx.fit_x(a, chosen, 2).x)


@query(
    "cx4_relative_error",
    f"""{_FIT}
SELECT {sql_round("sqrt(1 - (SELECT sum(p * x0 + q * x1) FROM x) / sum(val * val))")} AS val
FROM part_nation""",
)
def cx4_error(spark, sf):
    a, chosen = _with_chosen(spark, sf)
    return rounded(cx.fit_x(a, chosen, 2).relative_error)


@query(
    "cx4_relative_error_joined",
    f"""{_FIT}
SELECT {sql_round("sqrt(1 - (SELECT sum(p * x0 + q * x1) FROM x) / sum(val * val))")} AS val
FROM part_nation""",
)
def cx4_error_joined(spark, sf):
    a, chosen = _with_chosen(spark, sf)
    return rounded(cx.fit_x(a, chosen, 2, basis="table").relative_error)


# -- NMF --------------------------------------------------------------------------


def xray_sql(matrix: str, positive: bool, scaled: bool) -> str:
    """CTEs up to k1(j), k2(j) (picks) and h(j, h1, h2) for two picks, on A's scale."""
    part = "greatest({0}, 0)" if positive else "{0}"
    size = "CASE WHEN s > 0 THEN s END" if scaled else "CASE WHEN s > 0 THEN 1 END"
    first = part.format("g")
    second = part.format("(x.g - h.h * y.g)")
    return f"""{fx.with_matrices(matrix)},
{fx.gram_sql("raw", matrix)},
d AS MATERIALIZED (SELECT col_id AS j, {size} AS d FROM (
  SELECT col_id, sum(abs(val)) AS s FROM {matrix} GROUP BY 1)),
g AS MATERIALIZED (
  SELECT r.i, r.j, r.g / (a.d * b.d) AS g
  FROM raw r JOIN d a ON a.j = r.i JOIN d b ON b.j = r.j
  WHERE a.d IS NOT NULL AND b.d IS NOT NULL),
n AS MATERIALIZED (SELECT j, sqrt(g) AS n FROM g WHERE i = j),
k1 AS MATERIALIZED (
  SELECT g.j FROM g JOIN n ON n.j = g.j GROUP BY g.j, n.n
  ORDER BY sqrt(sum({first} * {first})) / n.n DESC, g.j LIMIT 1),
h1 AS MATERIALIZED (
  SELECT g.j, greatest(g.g / (SELECT g FROM g WHERE i = j AND j = (SELECT j FROM k1)), 0) AS h
  FROM g WHERE g.i = (SELECT j FROM k1)),
k2 AS MATERIALIZED (
  SELECT x.j FROM g x JOIN h1 h ON h.j = x.i
  JOIN g y ON y.i = (SELECT j FROM k1) AND y.j = x.j JOIN n ON n.j = x.j
  WHERE x.j <> (SELECT j FROM k1) GROUP BY x.j, n.n
  ORDER BY sqrt(sum({second} * {second})) / n.n DESC, x.j LIMIT 1),
c AS MATERIALIZED (
  SELECT p.j, p.g AS p, q.g AS q,
         (SELECT g FROM g WHERE i = (SELECT j FROM k1) AND j = (SELECT j FROM k1)) AS a,
         (SELECT g FROM g WHERE i = (SELECT j FROM k1) AND j = (SELECT j FROM k2)) AS b,
         (SELECT g FROM g WHERE i = (SELECT j FROM k2) AND j = (SELECT j FROM k2)) AS c
  FROM g p JOIN g q ON q.j = p.j
  WHERE p.i = (SELECT j FROM k1) AND q.i = (SELECT j FROM k2)),
hs AS MATERIALIZED (
  SELECT j,
    CASE WHEN c * p >= b * q AND a * q >= b * p THEN (c * p - b * q) / (a * c - b * b)
         WHEN greatest(p, 0) * greatest(p, 0) / a >= greatest(q, 0) * greatest(q, 0) / c
         THEN greatest(p, 0) / a ELSE 0 END AS h1,
    CASE WHEN c * p >= b * q AND a * q >= b * p THEN (a * q - b * p) / (a * c - b * b)
         WHEN greatest(p, 0) * greatest(p, 0) / a >= greatest(q, 0) * greatest(q, 0) / c
         THEN 0 ELSE greatest(q, 0) / c END AS h2
  FROM c),
h AS MATERIALIZED (
  SELECT d.j, coalesce(hs.h1 * d.d / (SELECT d FROM d WHERE j = (SELECT j FROM k1)), 0) AS h1,
         coalesce(hs.h2 * d.d / (SELECT d FROM d WHERE j = (SELECT j FROM k2)), 0) AS h2
  FROM d LEFT JOIN hs ON hs.j = d.j)"""


_PICKS = """SELECT 0::BIGINT AS rank_pos, j AS col_id FROM k1
UNION ALL SELECT 1, j FROM k2"""
_H = f"""SELECT 0::BIGINT AS comp, j AS col_id, {sql_round("h1")} AS h FROM h
UNION ALL SELECT 1, j, {sql_round("h2")} FROM h"""


@query("fac12_select_columns", f"{xray_sql('part_nation', True, True)}\n{_PICKS}")
def fac12(spark, sf):
    return nmf(fx.part_nation(spark, sf), 2, return_w=False).columns


@query("fac13_select_columns_norm", f"{xray_sql('part_nation', False, False)}\n{_PICKS}")
def fac13(spark, sf):
    return nmf(fx.part_nation(spark, sf), 2, "norm", scale_columns=False, return_w=False).columns


@query("fac16_nmf_indices_h", f"{xray_sql('part_nation', True, True)}\n{_H}")
def fac16(spark, sf):
    return rounded(nmf(fx.part_nation(spark, sf), 2, return_w=False).h, 1, 6, "h")


@query(
    "fac16_nmf_clamp_log",
    xray_sql("part_nation", True, True).replace(
        "coalesce(e.val, 0.0) AS val", "ln(1 + coalesce(e.val, 0.0)) AS val"
    )
    + "\n"
    + _H,
)
def fac16_clamp_log(spark, sf):
    model = nmf(fx.part_nation(spark, sf), 2, negatives="clamp_log", return_w=False)
    return rounded(model.h, 1, 6, "h")


@query("fac16_saved_nmf", f"{xray_sql('part_nation', True, True)}\n{_H}")
def fac16_saved(spark, sf):
    path = scratch_path(spark, "nmf")
    nmf(fx.part_nation(spark, sf), 2, return_w=False).save(path)
    return rounded(load_nmf(spark, path, with_w=False)["h"], 1, 6, "h")


@query(
    "fac17_nmf_w",
    f"""{xray_sql("part_nation", True, True)}
SELECT a.row_id, 0::BIGINT AS col_id, {sql_round("a.val")} AS val
FROM part_nation a WHERE a.col_id = (SELECT j FROM k1)
UNION ALL SELECT a.row_id, 1, {sql_round("a.val")}
FROM part_nation a WHERE a.col_id = (SELECT j FROM k2)""",
)
def fac17(spark, sf):
    return long(nmf(fx.part_nation(spark, sf), 2).w)


@query(
    "fac17_nmf_relative_error",
    f"""{xray_sql("part_nation", True, True)},
w AS (SELECT row_id, max(CASE WHEN col_id = (SELECT j FROM k1) THEN val END) AS w1,
             max(CASE WHEN col_id = (SELECT j FROM k2) THEN val END) AS w2
      FROM part_nation GROUP BY 1)
SELECT {sql_round("sqrt(sum(pow(a.val - w.w1 * h.h1 - w.w2 * h.h2, 2)) / sum(a.val * a.val))")}
       AS val
FROM part_nation a JOIN w ON w.row_id = a.row_id JOIN h ON h.j = a.col_id""",
)
def fac17_error(spark, sf):
    return rounded(nmf(fx.part_nation(spark, sf).keep(), 2).relative_error())


@query(
    "pre8_unscaled_h",
    f"""{xray_sql("cust_prio", True, True)}
SELECT d.j AS col_id,
       {sql_round("h1.h * d.d / (SELECT d FROM d WHERE j = (SELECT j FROM k1))")} AS h
FROM d JOIN h1 ON h1.j = d.j""",
)
def pre8(spark, sf):
    model = nmf(fx.cust_prio(spark, sf), 1, return_w=False)
    return rounded(model.h.select("col_id", "h"), 1, 6, "h")


# -- non-negative and plain least squares ------------------------------------------

_BASIS = np.array([[1.0, 2.0, 0.0, 1.0, 3.0], [2.0, 0.0, 1.0, 1.0, 0.5]])


def _dot(basis: np.ndarray) -> str:
    values = ", ".join(f"{x!r}" for x in basis.tolist())
    return f"sum(([{values}])[col_id + 1] * val)"


_TWO_UNKNOWNS = f"""{fx.with_matrices("cust_prio")},
r AS (SELECT row_id, col_id, val - avg(val) OVER (PARTITION BY row_id) AS val FROM cust_prio),
c AS (SELECT row_id, {_dot(_BASIS[0])} AS p, {_dot(_BASIS[1])} AS q,
             15.0 AS a, 4.5 AS b, 6.25 AS c FROM r GROUP BY 1),
h AS (SELECT row_id,
    CASE WHEN c * p >= b * q AND a * q >= b * p THEN (c * p - b * q) / (a * c - b * b)
         WHEN greatest(p, 0) * greatest(p, 0) / a >= greatest(q, 0) * greatest(q, 0) / c
         THEN greatest(p, 0) / a ELSE 0 END AS h1,
    CASE WHEN c * p >= b * q AND a * q >= b * p THEN (a * q - b * p) / (a * c - b * b)
         WHEN greatest(p, 0) * greatest(p, 0) / a >= greatest(q, 0) * greatest(q, 0) / c
         THEN 0 ELSE greatest(q, 0) / c END AS h2 FROM c)
SELECT row_id, 0::BIGINT AS comp, {sql_round("h1")} AS h, true AS converged FROM h
UNION ALL SELECT row_id, 1, {sql_round("h2")}, true FROM h"""


def _exploded(df):
    parts = df.select("row_id", F.posexplode("h").alias("comp", "h"), "converged")
    return rounded(parts.withColumn("comp", F.col("comp").cast("bigint")), 1, 6, "h")


@query("fac14_nnls_rows", _TWO_UNKNOWNS)
def fac14(spark, sf):
    targets = preprocess.center_rows(fx.cust_prio(spark, sf))
    return _exploded(nnls.nnls_rows(targets, _BASIS))


_WEIGHTS = np.array([0.5, 0.0, 2.0, 1e-21, 1.0])


def _weighted(squares: list[float]) -> str:
    b = _BASIS[0]
    top = _dot(b * np.array(squares))
    return f"""{fx.with_matrices("cust_prio")}
SELECT row_id, 0::BIGINT AS comp, {sql_round(f"greatest({top} / {float((b * b * squares).sum())!r}, 0)")} AS h,
       true AS converged
FROM (SELECT row_id, col_id, val - avg(val) OVER (PARTITION BY row_id) AS val FROM cust_prio)
GROUP BY 1"""


@query("fac15_weighted_nnls", _weighted([0.5, 0.0, 2.0, 0.0, 1.0]))
def fac15(spark, sf):
    targets = preprocess.center_rows(fx.cust_prio(spark, sf))
    return _exploded(nnls.nnls_rows(targets, _BASIS[:1], _WEIGHTS))


@query("fac15_root_weighted_nnls", _weighted([0.25, 0.0, 4.0, 0.0, 1.0]))
def fac15_roots(spark, sf):
    targets = preprocess.center_rows(fx.cust_prio(spark, sf))
    return _exploded(nnls.nnls_rows(targets, _BASIS[:1], _WEIGHTS, weights_are_roots=True))


def _regression(spark, sf) -> TallMatrix:
    """Quantity and a constant, then order price (in thousands) and tax as the targets."""
    df = fx.order_measures(spark, sf).select(
        "row_id", "l_quantity", F.lit(1.0).alias("one"),
        (F.col("l_extendedprice") / 1000).alias("price"), "l_tax",
    )
    return TallMatrix.from_columns(df, ["l_quantity", "one", "price", "l_tax"])


_REGRESSION = """o AS MATERIALIZED (
  SELECT l_orderkey, sum(l_quantity) AS x, sum(l_extendedprice) / 1000 AS y0, sum(l_tax) AS y1
  FROM lineitem GROUP BY 1)"""


@query(
    "fac18_least_squares",
    f"""WITH {_REGRESSION},
t AS (SELECT x, 0::BIGINT AS target, y0 AS y FROM o UNION ALL SELECT x, 1, y1 FROM o)
SELECT target, {sql_round("regr_slope(y, x)", 1, 7)} AS slope,
       {sql_round("regr_intercept(y, x)")} AS intercept,
       {sql_round("sqrt(regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x))", 1000)} AS residual
FROM t GROUP BY 1""",
)
def fac18(spark, sf):
    fit = tsqr.least_squares(_regression(spark, sf), 2)
    rows = [
        (t, float(fit.x[0, t]), float(fit.x[1, t]), float(fit.residual[t])) for t in range(2)
    ]
    df = spark.createDataFrame(
        rows, "target BIGINT, slope DOUBLE, intercept DOUBLE, residual DOUBLE"
    )
    df = rounded(df, 1, 7, "slope")
    return rounded(rounded(df, 1, 6, "intercept"), 1000, 6, "residual")


_LAMBDAS = [0.5, 10.0, 1000.0]


@query(
    "fac19_ridge",
    f"""WITH {_REGRESSION},
e AS (SELECT sum(x * x) AS a, sum(x) AS b, count(*) AS c, sum(x * y0) AS p0, sum(y0) AS q0,
             sum(x * y1) AS p1, sum(y1) AS q1 FROM o),
l AS (SELECT unnest([0.5, 10.0, 1000.0])::DOUBLE AS lam),
t AS (SELECT lam, 0::BIGINT AS target, a + lam AS a, b, c + lam AS c, p0 AS p, q0 AS q
      FROM e CROSS JOIN l
      UNION ALL SELECT lam, 1, a + lam, b, c + lam, p1, q1 FROM e CROSS JOIN l)
SELECT lam AS lambda, target, {sql_round("(c * p - b * q) / (a * c - b * b)", 1, 7)} AS slope,
       {sql_round("(a * q - b * p) / (a * c - b * b)", 1, 7)} AS intercept
FROM t""",
)
def fac19(spark, sf):
    both = _regression(spark, sf)
    solutions = tsqr.ridge(both.col_slice(0, 2), both.col_slice(2, 4), _LAMBDAS)
    rows = [
        (lam, t, float(x[0, t]), float(x[1, t]))
        for lam, x in zip(_LAMBDAS, solutions)
        for t in range(2)
    ]
    schema = "lambda DOUBLE, target BIGINT, slope DOUBLE, intercept DOUBLE"
    return rounded(spark.createDataFrame(rows, schema), 1, 7, "slope", "intercept")


@query("fac12_select_columns_wide", f"{xray_sql('part_nation', True, True)}\n{_PICKS}")
def fac12_wide(spark, sf):
    return nmf(fx.part_nation(spark, sf), 2, return_w=False, max_direct_cols=8).columns


@query("fac16_nmf_h_wide", f"{xray_sql('part_nation', True, True)}\n{_H}")
def fac16_wide(spark, sf):
    model = nmf(fx.part_nation(spark, sf), 2, return_w=False, max_direct_cols=8)
    return rounded(model.h, 1, 6, "h")
