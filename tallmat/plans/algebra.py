"""Queries over the element-wise algebra, the reductions and the preprocessing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallmat.operators import preprocess as pre
from tallmat.operators import stats
from tallmat.operators.products import map_blocks
from tallmat.operators.tsqr import tsqr
from tallmat.plans import fixtures as fx
from tallmat.plans.registry import long, query, rounded, sql_round


def elementwise(matrix: str, expr: str, where: str = "true", scale: float = 1.0) -> str:
    return f"""{fx.with_matrices(matrix)}
SELECT row_id, col_id, {sql_round(expr, scale)} AS val FROM {matrix} WHERE {where}"""


# -- element-wise -----------------------------------------------------------


@query("elt1_add_scalar", elementwise("user_event", "val + 2.5"))
def elt1(spark, sf):
    return long(fx.user_event(spark, sf) + 2.5)


@query("elt2_subtract_scalar", elementwise("user_event", "val - 1.25"))
def elt2(spark, sf):
    return long(fx.user_event(spark, sf) - 1.25)


@query("elt3_multiply_scalar", elementwise("part_nation", "val * 3"))
def elt3(spark, sf):
    return long(fx.part_nation(spark, sf) * 3)


@query("elt4_divide_scalar", elementwise("part_nation", "val / 7"))
def elt4(spark, sf):
    return long(fx.part_nation(spark, sf) / 7)


@query("elt5_power", elementwise("supp_month", "pow(val, 1.5)", scale=1000))
def elt5(spark, sf):
    return long(fx.supp_month(spark, sf) ** 1.5, 1000)


@query("elt6_map_elements", elementwise("cust_prio", "sqrt(abs(val - 100)) + sin(val)"))
def elt6(spark, sf):
    return long(fx.cust_prio(spark, sf).map_elements(lambda x: F.sqrt(F.abs(x - 100)) + F.sin(x)))


_TWO_EVENT = f"""{fx.with_matrices("user_event", "user_event_count")}
SELECT a.row_id, a.col_id, {{}} AS val
FROM user_event a JOIN user_event_count b ON a.row_id = b.row_id AND a.col_id = b.col_id"""


@query("elt7_add_matrix", _TWO_EVENT.format(sql_round("a.val + b.val")))
def elt7(spark, sf):
    return long(fx.user_event(spark, sf) + fx.user_event_count(spark, sf))


@query("elt8_subtract_matrix", _TWO_EVENT.format(sql_round("a.val - b.val")))
def elt8(spark, sf):
    return long(fx.user_event(spark, sf) - fx.user_event_count(spark, sf))


@query(
    "elt9_column_slice",
    f"""{fx.with_matrices("part_nation")}
SELECT row_id, col_id - 5 AS col_id, {sql_round("val")} AS val FROM part_nation
WHERE col_id >= 5 AND col_id < 12""",
)
def elt9(spark, sf):
    return long(fx.part_nation(spark, sf).col_slice(5, 12))


@query(
    "elt9_column_slice_sparse",
    f"""{fx.with_matrices("part_supp")}
SELECT row_id, col_id - 2 AS col_id, {sql_round("val")} AS val FROM part_supp
WHERE col_id >= 2 AND col_id < 9""",
)
def elt9_sparse(spark, sf):
    return long(fx.part_supp(spark, sf).col_slice(2, 9))


@query("elt10_row_slice", elementwise("emb", "val", "row_id >= 100 AND row_id < 350"))
def elt10(spark, sf):
    return long(fx.emb(spark, sf).row_slice(100, 350))


@query(
    "elt11_row_column_slice",
    f"""{fx.with_matrices("emb")}
SELECT row_id, col_id - 8 AS col_id, {sql_round("val")} AS val FROM emb
WHERE row_id >= 37 AND row_id < 411 AND col_id >= 8 AND col_id < 20""",
)
def elt11(spark, sf):
    return long(fx.emb(spark, sf).slice((37, 411), (8, 20)))


@query(
    "elt12_gather_columns",
    f"""{fx.with_matrices("part_nation")}
SELECT row_id, CASE col_id WHEN 9 THEN 0 WHEN 12 THEN 1 ELSE 2 END::BIGINT AS col_id,
       {sql_round("val")} AS val
FROM part_nation WHERE col_id IN (9, 12, 3)""",
)
def elt12(spark, sf):
    return long(fx.part_nation(spark, sf).gather([9, 12, 3]))


@query("elt13_clamp_log", elementwise("emb", "CASE WHEN val < 0 THEN 0 ELSE ln(val + 1) END"))
def elt13(spark, sf):
    return long(pre.clamp_log(fx.emb(spark, sf)))


@query(
    "elt14_negative_check",
    f"""{fx.with_matrices("emb")}
SELECT count(DISTINCT CASE WHEN val < 0 THEN row_id END) AS rows_with_negative,
       {sql_round("min(val)")} AS smallest
FROM emb""",
)
def elt14(spark, sf):
    return rounded(pre.count_negative(fx.emb(spark, sf)), 1.0, 6, "smallest")


@query("elt15_map_blocks", elementwise("emb", "abs(val) * 2 + 1"))
def elt15(spark, sf):
    return long(map_blocks(fx.emb(spark, sf), lambda x: np.abs(x) * 2 + 1))


# -- reductions -------------------------------------------------------------


@query(
    "agg1_dimensions",
    f"""{fx.with_matrices("part_nation")}
SELECT count(DISTINCT row_id) AS n_rows, count(DISTINCT col_id) AS n_cols, count(*) AS n_elements
FROM part_nation""",
)
def agg1(spark, sf):
    return fx.part_nation(spark, sf).dims()


@query(
    "agg2_aggregate_elements",
    f"""{fx.with_matrices("emb")}
SELECT {sql_round("sum(abs(val) * abs(val) * abs(val))")} AS val FROM emb""",
)
def agg2(spark, sf):
    cubes = stats.aggregate_all(
        fx.emb(spark, sf), F.lit(0.0), lambda acc, x: acc + F.abs(x) * x * x, F.sum
    )
    return rounded(cubes)


@query(
    "agg2_aggregate_blocks",
    f"""{fx.with_matrices("emb")}
SELECT 0::BIGINT AS pos, {sql_round("max(abs(val))")} AS val FROM emb
UNION ALL SELECT 1, {sql_round("-min(val)")} FROM emb""",
)
def agg2_blocks(spark, sf):
    extremes = stats.aggregate_blocks(
        fx.emb(spark, sf), lambda x: [np.abs(x).max(), -x.min()], np.maximum, 2
    )
    return rounded(extremes)


def _reduce_all(how: str, expr: str) -> str:
    return f"{fx.with_matrices('emb')} SELECT {sql_round(expr)} AS val FROM emb"


@query("agg3_reduce_sum", _reduce_all("sum", "sum(val)"))
def agg3_sum(spark, sf):
    return rounded(stats.reduce_all(fx.emb(spark, sf), "sum"))


@query("agg3_reduce_min", _reduce_all("min", "min(val)"))
def agg3_min(spark, sf):
    return rounded(stats.reduce_all(fx.emb(spark, sf), "min"))


@query("agg3_reduce_max", _reduce_all("max", "max(val)"))
def agg3_max(spark, sf):
    return rounded(stats.reduce_all(fx.emb(spark, sf), "max"))


@query("agg3_reduce_product", _reduce_all("product", "product(1 + val / 1000)"))
def agg3_product(spark, sf):
    return rounded(stats.reduce_all(fx.emb(spark, sf).map_elements(lambda x: 1 + x / 1000), "product"))


@query("agg3_reduce_any", _reduce_all("hypot", "sqrt(sum(val * val))"))
def agg3_any(spark, sf):
    return rounded(stats.reduce_with(fx.emb(spark, sf), np.hypot))


@query(
    "agg4_reduce_rows",
    f"""{fx.with_matrices("user_event")}
SELECT row_id, {sql_round("max(val)")} AS val FROM user_event GROUP BY 1""",
)
def agg4(spark, sf):
    return rounded(stats.reduce_rows(fx.user_event(spark, sf), F.greatest))


@query(
    "agg5_reduce_columns",
    f"""{fx.with_matrices("part_nation")}
SELECT col_id, {sql_round("max(val)")} AS val FROM part_nation GROUP BY 1""",
)
def agg5(spark, sf):
    return rounded(stats.reduce_cols(fx.part_nation(spark, sf), F.max))


@query(
    "agg5_reduce_columns_any",
    f"""{fx.with_matrices("emb")}
SELECT col_id, {sql_round("sqrt(sum(val * val))")} AS val FROM emb GROUP BY 1""",
)
def agg5_any(spark, sf):
    return rounded(stats.reduce_cols_with(fx.emb(spark, sf), np.hypot))


@query(
    "agg5_reduce_columns_sparse",
    f"""{fx.with_matrices("part_supp")}
SELECT col_id, {sql_round("sum(val)")} AS val FROM part_supp GROUP BY 1""",
)
def agg5_sparse(spark, sf):
    return rounded(stats.reduce_coo(fx.part_supp(spark, sf), "col_id", F.sum))


@query(
    "agg6_row_sums",
    f"""{fx.with_matrices("emb")}
SELECT row_id, {sql_round("sum(val)")} AS val FROM emb GROUP BY 1""",
)
def agg6(spark, sf):
    return rounded(stats.row_sums(fx.emb(spark, sf)))


@query(
    "agg7_column_sums",
    f"""{fx.with_matrices("part_nation")}
SELECT col_id, {sql_round("sum(val)")} AS val FROM part_nation GROUP BY 1""",
)
def agg7(spark, sf):
    return rounded(stats.col_sums(fx.part_nation(spark, sf)))


@query(
    "agg8_frobenius",
    f"""{fx.with_matrices("emb")}
SELECT {sql_round("sqrt(sum(val * val))")} AS val FROM emb""",
)
def agg8(spark, sf):
    return rounded(stats.frobenius(fx.emb(spark, sf)))


@query(
    "agg9_row_means",
    f"""{fx.with_matrices("user_event")}
SELECT row_id, {sql_round("avg(val)")} AS val FROM user_event GROUP BY 1""",
)
def agg9(spark, sf):
    return rounded(stats.row_means(fx.user_event(spark, sf)))


@query(
    "agg9_row_means_sparse",
    f"""{fx.with_matrices("part_supp")}
SELECT row_id, {sql_round("sum(val) / (SELECT max(s_suppkey) + 1 FROM supplier)")} AS val
FROM part_supp GROUP BY 1""",
)
def agg9_sparse(spark, sf):
    return rounded(stats.row_means(fx.part_supp(spark, sf)))


@query(
    "agg10_row_mean_std",
    f"""{fx.with_matrices("cust_prio")}
SELECT row_id, {sql_round("avg(val)")} AS mean,
       {sql_round("CASE WHEN stddev_samp(val) < 1e-4 THEN 1 ELSE stddev_samp(val) END")} AS std,
       stddev_samp(val) < 1e-4 AS low_std
FROM cust_prio GROUP BY 1""",
)
def agg10(spark, sf):
    return rounded(stats.row_mean_std(fx.cust_prio(spark, sf)), 1.0, 6, "mean", "std")


@query(
    "agg11_column_l1",
    f"""{fx.with_matrices("emb")}
SELECT col_id, {sql_round("sum(abs(val))")} AS val FROM emb GROUP BY 1""",
)
def agg11(spark, sf):
    norms = tsqr(fx.emb(spark, sf)).col_l1
    return rounded(
        spark.createDataFrame([(j, float(x)) for j, x in enumerate(norms)], "col_id BIGINT, val DOUBLE")
    )


@query(
    "agg12_column_l2",
    f"""{fx.with_matrices("emb")}
SELECT col_id, {sql_round("sqrt(sum(val * val))")} AS val FROM emb GROUP BY 1""",
)
def agg12(spark, sf):
    return rounded(stats.col_norms_l2(fx.emb(spark, sf)))


@query("agg13_distinct_ids", "SELECT DISTINCT l_partkey AS row_id FROM lineitem")
def agg13(spark, sf):
    return fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("row_id")).distinct()


@query(
    "agg10_row_mean_std_sparse",
    f"""{fx.with_matrices("part_nation")}
SELECT row_id, {sql_round("avg(val)")} AS mean, {sql_round("stddev_samp(val)")} AS std,
       false AS low_std
FROM part_nation GROUP BY 1""",
)
def agg10_sparse(spark, sf):
    sparse = fx.part_nation(spark, sf).to_coo()
    return rounded(stats.row_mean_std(sparse), 1.0, 6, "mean", "std")


# part_nation against the rank-1 product of its row sums and column shares
_ERROR = f"""{fx.with_matrices("part_nation")},
r AS (SELECT row_id, sum(val) AS s FROM part_nation GROUP BY 1),
d AS (SELECT a.val, a.val - r.s * ((a.col_id + 1) / 325.0) AS e
      FROM part_nation a JOIN r ON a.row_id = r.row_id)
SELECT {{}} AS val FROM d"""


def _rank_one(spark, sf):
    a = fx.part_nation(spark, sf)
    left = a.with_v(F.array(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)), 1)
    right = (np.arange(fx.NATIONS) + 1.0)[None, :] / 325.0
    return a, left, right


@query("agg14_squared_error", _ERROR.format(sql_round("sum(e * e)", 1e6)))
def agg14(spark, sf):
    return rounded(stats.squared_error(*_rank_one(spark, sf)), 1e6)


@query("agg15_relative_error", _ERROR.format(sql_round("sqrt(sum(e * e) / sum(val * val))")))
def agg15(spark, sf):
    return rounded(stats.relative_error(*_rank_one(spark, sf)))


@query(
    "mat_keep_coalesce",
    f"""{fx.with_matrices("supp_month")}
SELECT count(DISTINCT row_id) AS n_rows, count(DISTINCT col_id) AS n_cols, count(*) AS n_elements
FROM supp_month""",
)
def mat_keep_coalesce(spark, sf):
    return fx.supp_month(spark, sf).keep().coalesce(2).dims()


# -- preprocessing ------------------------------------------------------------


@query(
    "pre1_center_rows",
    f"""{fx.with_matrices("user_event")}
SELECT row_id, col_id, {sql_round("val - avg(val) OVER (PARTITION BY row_id)")} AS val
FROM user_event""",
)
def pre1(spark, sf):
    return long(pre.center_rows(fx.user_event(spark, sf)))


@query(
    "pre1_center_rows_by_saved_means",
    f"""{fx.with_matrices("user_event", "user_event_count")},
m AS (SELECT row_id, avg(val) AS mean FROM user_event_count GROUP BY 1)
SELECT a.row_id, a.col_id, {sql_round("a.val - m.mean")} AS val
FROM user_event a JOIN m ON a.row_id = m.row_id""",
)
def pre1_saved(spark, sf):
    means = stats.row_mean_std(fx.user_event_count(spark, sf))
    return long(pre.center_rows(fx.user_event(spark, sf), means))


_STD = "CASE WHEN stddev_samp({0}) OVER w < 1e-4 THEN 1 ELSE stddev_samp({0}) OVER w END"


@query(
    "pre2_standardize_rows",
    f"""{fx.with_matrices("cust_prio")}
SELECT row_id, col_id, {sql_round(f"(val - avg(val) OVER w) / ({_STD.format('val')})")} AS val
FROM cust_prio WINDOW w AS (PARTITION BY row_id)""",
)
def pre2(spark, sf):
    return long(pre.standardize_rows(fx.cust_prio(spark, sf)))


_LAT_WEIGHT = "sqrt(greatest(cos(radians(lat)), 0))"


@query(
    "pre3_weight_rows",
    f"""{fx.with_matrices("supp_month", "latitude")}
SELECT a.row_id, a.col_id, {sql_round(f"a.val * {_LAT_WEIGHT}")} AS val
FROM supp_month a JOIN latitude w ON a.row_id = w.row_id""",
)
def pre3(spark, sf):
    return long(pre.weight_rows(fx.supp_month(spark, sf), pre.latitude_weights(fx.weights(spark, sf))))


@query(
    "pre4_weight_means",
    f"""{fx.with_matrices("supp_month", "latitude")}
SELECT a.row_id, {sql_round(f"avg(a.val) * any_value({_LAT_WEIGHT})")} AS val
FROM supp_month a JOIN latitude w ON a.row_id = w.row_id GROUP BY 1""",
)
def pre4(spark, sf):
    weights = pre.latitude_weights(fx.weights(spark, sf))
    _, row_stats = pre.preprocess(
        fx.supp_month(spark, sf), "cosLat+centerOverAllObservations", weights
    )
    return rounded(pre.weight_means(row_stats))


@query(
    "pre5_latitude_weights",
    f"""{fx.with_matrices("latitude")}
SELECT row_id, {sql_round(_LAT_WEIGHT)} AS weight FROM latitude""",
)
def pre5(spark, sf):
    return rounded(pre.latitude_weights(fx.weights(spark, sf)), 1.0, 6, "weight")


def _prepared(method: str, matrix: str, expr: str, joins: str = "") -> str:
    return f"""{fx.with_matrices(matrix, "latitude")}
SELECT a.row_id, a.col_id, {sql_round(expr)} AS val FROM {matrix} a {joins}
WINDOW w AS (PARTITION BY a.row_id)"""


@query("pre6_none", _prepared("none", "supp_month", "a.val"))
def pre6_none(spark, sf):
    return long(pre.preprocess(fx.supp_month(spark, sf), "none")[0])


@query("pre6_center", _prepared("center", "supp_month", "a.val - avg(a.val) OVER w"))
def pre6_center(spark, sf):
    return long(pre.preprocess(fx.supp_month(spark, sf), "centerOverAllObservations")[0])


@query(
    "pre6_standardize",
    _prepared("std", "supp_month", f"(a.val - avg(a.val) OVER w) / ({_STD.format('a.val')})"),
)
def pre6_standardize(spark, sf):
    return long(pre.preprocess(fx.supp_month(spark, sf), "standardizeEach")[0])


@query(
    "pre6_latitude_center",
    _prepared(
        "lat",
        "supp_month",
        f"(a.val - avg(a.val) OVER w) * {_LAT_WEIGHT}",
        "JOIN latitude l ON a.row_id = l.row_id",
    ),
)
def pre6_latitude(spark, sf):
    weights = pre.latitude_weights(fx.weights(spark, sf))
    method = "cosLat+centerOverAllObservations"
    return long(pre.preprocess(fx.supp_month(spark, sf), method, weights)[0])


@query(
    "pre7_unit_l1_columns",
    f"""{fx.with_matrices("part_nation")},
n AS (SELECT col_id, sum(abs(val)) AS s FROM part_nation GROUP BY 1)
SELECT a.row_id, a.col_id,
       {sql_round("CASE WHEN n.s > 0 THEN 1000 * a.val / n.s ELSE 0 END")} AS val
FROM part_nation a JOIN n ON a.col_id = n.col_id""",
)
def pre7(spark, sf):
    a = fx.part_nation(spark, sf)
    factors = pre.unit_l1_factors(tsqr(a).col_l1)
    return long(pre.scale_columns(a, factors * 1000))
