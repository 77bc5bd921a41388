"""Queries over sources and sinks: write to the shared folder, read back, compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallmat.functions.noise import normal
from tallmat.operators import pca, preprocess
from tallmat.operators.cx import CxScores, cx_scores
from tallmat.plans import fixtures as fx
from tallmat.plans.registry import long, query, rounded, sql_round
from tallmat.session import scratch_path
from tallmat.sources import index, readers, sinks

_PART_SUPP = f"""{fx.with_matrices("part_supp")}
SELECT row_id, col_id, {sql_round("val")} AS val FROM part_supp"""


# -- sources --------------------------------------------------------------


@query("src1_coo_csv", _PART_SUPP)
def src1(spark, sf):
    path = scratch_path(spark, "coo-csv")
    sinks.write_coo_csv(fx.part_supp(spark, sf), path)
    return long(readers.read_coo_csv(spark, path))


@query(
    "src2_indexed_rows",
    f"""{fx.with_matrices("part_supp")}
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY col_id) - 1 AS pos, col_id,
       {sql_round("val")} AS val
FROM part_supp""",
)
def src2(spark, sf):
    rows = fx.part_supp(spark, sf).segments()
    entries = rows.select("row_id", F.posexplode(F.arrays_zip("idx", "val")).alias("pos", "e"))
    return rounded(
        entries.select(
            "row_id",
            F.col("pos").cast("bigint").alias("pos"),
            F.col("e.idx").alias("col_id"),
            F.col("e.val").alias("val"),
        )
    )


def _keyed_entries(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("row_key"),
        F.col("l_shipdate").alias("col_key"),
        F.col("l_quantity").alias("val"),
    )


_COMPACTED = """e AS (
  SELECT l_orderkey, l_shipdate, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2),
c AS (SELECT dense_rank() OVER (ORDER BY l_orderkey) - 1 AS row_id,
             dense_rank() OVER (ORDER BY l_shipdate) - 1 AS col_id, val FROM e)"""


@query(
    "src3_compact_ids",
    f"WITH {_COMPACTED} SELECT row_id, col_id, {sql_round('val')} AS val FROM c",
)
def src3(spark, sf):
    return long(index.compact(_keyed_entries(spark, sf)).matrix)


@query(
    "src4_compacted_scan",
    f"""WITH {_COMPACTED}
SELECT row_id, col_id, {sql_round("val")} AS val,
       (SELECT count(DISTINCT row_id) FROM c) AS n_rows,
       (SELECT count(DISTINCT col_id) FROM c) AS n_cols
FROM c""",
)
def src4(spark, sf):
    path = scratch_path(spark, "compacted")
    sinks.save_compacted(index.compact(_keyed_entries(spark, sf)), path)
    matrix, n_rows = readers.read_compacted(spark, path)
    sized = long(matrix).withColumn("n_rows", F.lit(n_rows).cast("bigint"))
    return sized.withColumn("n_cols", F.lit(matrix.n_cols).cast("bigint"))


@query("src5_saved_rows", _PART_SUPP)
def src5(spark, sf):
    a, path = fx.part_supp(spark, sf), scratch_path(spark, "rows")
    sinks.write_rows(a, path)
    return long(readers.read_segments(spark, path, a.n_cols))


@query("src6_matrix_market_sparse", _PART_SUPP)
def src6(spark, sf):
    a, path = fx.part_supp(spark, sf), scratch_path(spark, "mm")
    n_rows = a.df.agg(F.max("row_id")).first()[0] + 1
    sinks.write_matrix_market(a.df, n_rows, a.n_cols, path)
    return long(readers.read_matrix_market(spark, path).coo())


@query(
    "src7_matrix_market_checked",
    f"""{fx.with_matrices("cust_prio")}
SELECT row_id, col_id, {sql_round("val")} AS val FROM cust_prio""",
)
def src7(spark, sf):
    a, path = fx.cust_prio(spark, sf), scratch_path(spark, "mm")
    n_rows = a.df.agg(F.max("row_id")).first()[0] + 1
    sinks.write_tall_matrix_market(a, n_rows, path)
    return rounded(readers.read_matrix_market_checked(spark, path).entries)


def _manifest(spark, *lines: str) -> str:
    path = scratch_path(spark, "manifest")
    spark.createDataFrame([(line,) for line in lines], "value STRING").coalesce(1).write.text(path)
    return path


@query(
    "src8_manifest",
    f"""{fx.with_matrices("emb")}
SELECT row_id, col_id, {sql_round("val")} AS val FROM emb
UNION ALL SELECT row_id + (SELECT count(*) FROM embeddings), col_id, {sql_round("val")} FROM emb""",
)
def src8(spark, sf):
    # vec_id is the place of a row in its file
    line = f"{sf}/embeddings.parquet embedding 4"
    return long(readers.read_manifest(spark, _manifest(spark, line, line)))


@query(
    "src8_manifest_ordered",
    f"""WITH n AS (SELECT row_number() OVER (ORDER BY label % 2, vec_id) - 1 AS row_id, embedding
  FROM embeddings)
SELECT row_id, unnest(range(64)) AS col_id, {sql_round("unnest(embedding)::DOUBLE")} AS val FROM n""",
)
def src8_ordered(spark, sf):
    lines = []
    for half in range(2):
        path = scratch_path(spark, f"half-{half}")
        df = fx.table(spark, sf, "embeddings").where(F.col("label") % 2 == half)
        df.repartition(3).write.parquet(path)
        lines.append(f"{path} embedding 2")
    return long(readers.read_manifest(spark, _manifest(spark, *lines), order_by="vec_id"))


_EMB = f"""{fx.with_matrices("emb")}
SELECT row_id, col_id, {sql_round("val")} AS val FROM emb"""


@query("src9_dense_dataset", _EMB)
def src9(spark, sf):
    return long(readers.read_dense(spark, f"{sf}/embeddings.parquet", "embedding", "vec_id", 4))


@query(
    "src10_double_columns",
    f"""{fx.with_matrices("order4")}
SELECT row_id, col_id, {sql_round("val")} AS val FROM order4""",
)
def src10(spark, sf):
    return long(fx.order4(spark, sf))


@query("src11_row_blocks", _EMB)
def src11(spark, sf):
    df = fx.table(spark, sf, "embeddings")
    # a block is 7 consecutive rows
    rows = F.sort_array(F.collect_list(F.struct("vec_id", F.col("embedding").alias("v"))))
    blocks = df.groupBy(F.floor(F.col("vec_id") / 7).alias("block_id")).agg(rows.alias("r"))
    blocks = blocks.select("block_id", F.col("r.v").cast("array<array<double>>").alias("rows"))
    return long(readers.from_blocks(blocks, fx.EMBEDDING))


def _part_ids(spark, sf):
    return fx.table(spark, sf, "part").select(F.col("p_partkey").cast("bigint").alias("row_id"))


@query(
    "src12_random_uniform",
    """SELECT p_partkey::BIGINT AS row_id, 8::BIGINT AS n_values, true AS in_unit, true AS varied
FROM part""",
)
def src12(spark, sf):
    a = readers.random_rows(_part_ids(spark, sf), 8, seed=5)
    return a.df.select(
        "row_id",
        F.size("v").cast("bigint").alias("n_values"),
        F.forall("v", lambda x: (x >= 0) & (x < 1)).alias("in_unit"),
        (F.size(F.array_distinct("v")) == 8).alias("varied"),
    )


@query(
    "src13_random_normal",
    """SELECT count(*) * 16 AS n_values, true AS mean_near_0, true AS variance_near_1 FROM part""",
)
def src13(spark, sf):
    draws = readers.random_rows(_part_ids(spark, sf), 16, seed=5, draw=normal).entries()
    n = F.count("*")
    return draws.agg(
        n.alias("n_values"),
        # five standard errors
        (F.abs(F.avg("val")) < 5 / F.sqrt(n)).alias("mean_near_0"),
        (F.abs(F.var_samp("val") - 1) < 5 * F.sqrt(2 / n)).alias("variance_near_1"),
    )


@query(
    "src14_row_weights",
    f"SELECT s_suppkey AS row_id, {sql_round('1 + (s_suppkey % 7) / 10.0::DOUBLE')} AS weight FROM supplier",
)
def src14(spark, sf):
    path = scratch_path(spark, "weights")
    weight = 1 + (F.col("s_suppkey") % 7) / 10.0
    fx.table(spark, sf, "supplier").select("s_suppkey", weight.alias("w")).write.csv(path)
    return rounded(readers.read_row_weights(spark, path), 1, 6, "weight")


@query(
    "src15_latitude_weights",
    f"""{fx.with_matrices("latitude")}
SELECT row_id, {sql_round("sqrt(greatest(cos(radians(lat)), 0))")} AS weight FROM latitude""",
)
def src15(spark, sf):
    path = scratch_path(spark, "latitudes")
    fx.weights(spark, sf).write.csv(path)
    return rounded(readers.read_latitude_weights(spark, path), 1, 6, "weight")


_CENTERED = """,
a AS MATERIALIZED (
  SELECT row_id, col_id, val - avg(val) OVER (PARTITION BY row_id) AS val FROM user_event)"""
_CENTERED_EIGEN = f"""{fx.with_matrices("user_event")}{_CENTERED},
{fx.gram_sql("g", "a")},
{fx.top_eigen_sql("g", 2)}"""


def _saved_pca(spark, sf, matrix, **options) -> pca.PcaModel:
    path = scratch_path(spark, "pca")
    pca.pca(matrix(spark, sf), **options).save(path)
    return pca.PcaModel.load(spark, path)


@query(
    "src16_load_model",
    f"""{_CENTERED_EIGEN}
SELECT 's' AS part, comp AS id, 0::BIGINT AS comp, {sql_round("s", 1, 4)} AS val FROM ({fx.singular_sql(2)})
UNION ALL SELECT 'v', i, comp, {sql_round("x", 1, 4)} FROM ({fx.vectors_sql(2)})
UNION ALL SELECT 'u', u.row_id, u.comp, {sql_round("u.x / s.s", 1, 4)}
  FROM (SELECT a.row_id, v.comp, sum(a.val * v.x) AS x
        FROM a JOIN ({fx.vectors_sql(2)}) v ON v.i = a.col_id GROUP BY 1, 2) u
  JOIN ({fx.singular_sql(2)}) s ON s.comp = u.comp
UNION ALL SELECT 'mean', row_id, 0, {sql_round("avg(val)", 1, 4)} FROM user_event GROUP BY row_id""",
)
def src16(spark, sf):
    model = _saved_pca(spark, sf, fx.user_event, k=2)
    zero = F.lit(0).cast("bigint").alias("comp")

    def part(name, df):
        return df.select(F.lit(name).alias("part"), "id", "comp", "val")

    s = model.s.select(F.col("comp").alias("id"), zero, F.col("s").alias("val"))
    mean = model.row_stats.select(F.col("row_id").alias("id"), zero, F.col("mean").alias("val"))
    out = part("s", s).unionAll(part("mean", mean))
    for name, a in (("u", model.u), ("v", model.v)):
        entries = a.entries().select(F.col("row_id").alias("id"), F.col("col_id").alias("comp"), "val")
        out = out.unionAll(part(name, entries))
    return rounded(out, 1, 4)


# -- sinks ------------------------------------------------------------------


@query(
    "snk1_save_model",
    f"""{fx.with_matrices("user_event")}
SELECT row_id, {sql_round("avg(val)")} AS mean,
       {sql_round("CASE WHEN stddev_samp(val) < 1e-4 THEN 1 ELSE stddev_samp(val) END")} AS std
FROM user_event GROUP BY 1""",
)
def snk1(spark, sf):
    model = _saved_pca(spark, sf, fx.user_event, k=2, preprocess="standardizeEach")
    return rounded(model.row_stats.select("row_id", "mean", "std"), 1, 6, "mean", "std")


@query(
    "snk2_model_dimensions",
    """SELECT 2::BIGINT AS k, count(DISTINCT user_id) AS m,
       (SELECT count(DISTINCT event_type) FROM events) AS n,
       'centerOverAllObservations' AS preprocess
FROM events""",
)
def snk2(spark, sf):
    meta = _saved_pca(spark, sf, fx.user_event, k=2).meta
    row = (meta["k"], meta["m"], meta["n"], meta["preprocess"])
    return spark.createDataFrame([row], "k BIGINT, m BIGINT, n BIGINT, preprocess STRING")


@query(
    "snk3_save_weighted_model",
    f"""{fx.with_matrices("supp_month", "latitude")},
w AS (SELECT row_id, sqrt(greatest(cos(radians(lat)), 0)) AS weight FROM latitude)
SELECT a.row_id, {sql_round("avg(a.val)")} AS mean, {sql_round("any_value(w.weight)")} AS weight,
       {sql_round("avg(a.val) * any_value(w.weight)")} AS weighted_mean
FROM supp_month a JOIN w ON a.row_id = w.row_id GROUP BY 1""",
)
def snk3(spark, sf):
    model = _saved_pca(
        spark,
        sf,
        fx.supp_month,
        k=3,
        preprocess="cosLat+centerOverAllObservations",
        weights=preprocess.latitude_weights(fx.weights(spark, sf)),
    )
    stats = model.row_stats.select("row_id", "mean", "weight", "weighted_mean")
    return rounded(stats, 1, 6, "mean", "weight", "weighted_mean")


@query(
    "snk4_save_cx_scores",
    f"""{fx.with_matrices("user_event")},
{fx.gram_sql("g", "user_event")},
{fx.top_eigen_sql("g", 2)}
SELECT 's' AS part, comp AS id, {sql_round("s", 1000)} AS val FROM ({fx.singular_sql(2)})
UNION ALL SELECT 'col', i, {sql_round("sum(x * x) / 2")} FROM ({fx.vectors_sql(2)}) GROUP BY i
UNION ALL SELECT 'row', -1, 1.0""",
)
def snk4(spark, sf):
    path = scratch_path(spark, "cx")
    cx_scores(fx.user_event(spark, sf).to_coo(), 2, 3, 3).save(path)
    scores = CxScores.load(spark, path)

    def part(name, df, key, value):
        return df.select(F.lit(name).alias("part"), F.col(key).alias("id"), value.alias("val"))

    s = part("s", scores.s, "comp", F.col("s") / 1000)
    col = part("col", scores.col_lev, "col_id", F.col("p"))
    row = scores.row_lev.agg(F.sum("p").alias("val")).select(
        F.lit("row").alias("part"), F.lit(-1).cast("bigint").alias("id"), "val"
    )
    return rounded(s.unionAll(col).unionAll(row))


@query(
    "snk5_matrix_market_dense",
    f"""{fx.with_matrices("supp_month")}
SELECT row_id, col_id, {sql_round("val")} AS val FROM supp_month""",
)
def snk5(spark, sf):
    a, path = fx.supp_month(spark, sf), scratch_path(spark, "mm")
    sinks.write_tall_matrix_market(a, fx.supplier_count(spark, sf), path)
    return rounded(readers.read_matrix_market(spark, path).entries)


@query(
    "snk6_export_model",
    f"""{_CENTERED_EIGEN}
SELECT 'evalEOFs' AS part, comp AS row_id, 0::BIGINT AS col_id, {sql_round("s", 1, 4)} AS val
FROM ({fx.singular_sql(2)})
UNION ALL SELECT 'rowEOFs', i, comp, {sql_round("x", 1, 4)} FROM ({fx.vectors_sql(2)})
UNION ALL SELECT 'rowMeans', row_id, 0, {sql_round("avg(val)", 1, 4)} FROM user_event GROUP BY row_id
UNION ALL SELECT 'colEOFs', u.row_id, u.comp, {sql_round("u.x / s.s", 1, 4)}
  FROM (SELECT a.row_id, v.comp, sum(a.val * v.x) AS x
        FROM a JOIN ({fx.vectors_sql(2)}) v ON v.i = a.col_id GROUP BY 1, 2) u
  JOIN ({fx.singular_sql(2)}) s ON s.comp = u.comp""",
)
def snk6(spark, sf):
    path = scratch_path(spark, "export")
    sinks.export_model(_saved_pca(spark, sf, fx.user_event, k=2), path)
    out = None
    for part in ("colEOFs", "rowEOFs", "evalEOFs", "rowMeans"):
        entries = readers.read_matrix_market(spark, f"{path}/{part}").entries
        entries = entries.select(F.lit(part).alias("part"), "row_id", "col_id", "val")
        out = entries if out is None else out.unionAll(entries)
    return rounded(out, 1, 4)


@query("snk7_dictionaries", "SELECT DISTINCT l_orderkey AS row_key FROM lineitem")
def snk7(spark, sf):
    path = scratch_path(spark, "rowtab")
    compacted = index.compact(_keyed_entries(spark, sf))
    sinks.write_dictionary(compacted.rows, "row_key", "row_id", path)
    return spark.read.text(path).select(F.col("value").cast("bigint").alias("row_key"))


@query(
    "snk8_compacted_matrix",
    f"""WITH {_COMPACTED}
SELECT row_id, count(*) AS nnz, {sql_round("sum(val)")} AS total FROM c GROUP BY 1""",
)
def snk8(spark, sf):
    path = scratch_path(spark, "compacted")
    sinks.save_compacted(index.compact(_keyed_entries(spark, sf)), path)
    rows = spark.read.parquet(f"{path}/matrix")
    total = F.aggregate("val", F.lit(0.0), lambda acc, x: acc + x)
    per_segment = rows.select("row_id", F.size("idx").alias("n"), total.alias("t"))
    sums = per_segment.groupBy("row_id").agg(F.sum("n").alias("nnz"), F.sum("t").alias("total"))
    return rounded(sums, 1, 6, "total")
