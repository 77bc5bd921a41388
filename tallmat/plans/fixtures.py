"""Matrices derived from the test tables, and the same matrices in SQL.

In SQL a matrix is a CTE (row_id, col_id, val); a dense one lists every position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix, TallMatrix
from tallmat.session import MAX_DIRECT_COLS

NATIONS = 25
MONTHS = 12
PRIORITIES = 5
EMBEDDING = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pivot_sum(df: DataFrame, row, code, value, n: int) -> TallMatrix:
    """One row per key with n sums; aggregated before the shuffle, so hot keys are harmless."""
    df = df.select(row.cast("bigint").alias("row_id"), code.alias("code"), value.alias("x"))
    sums = [F.sum(F.when(F.col("code") == j, F.col("x")).otherwise(0.0)) for j in range(n)]
    wide = df.groupBy("row_id").agg(*[s.alias(f"c{j}") for j, s in enumerate(sums)])
    return TallMatrix(wide.select("row_id", F.array(*wide.columns[1:]).alias("v")), n)


def event_types(spark: SparkSession, sf: str) -> list[str]:
    kinds = table(spark, sf, "events").select("event_type").distinct()
    found = [r.event_type for r in kinds.limit(MAX_DIRECT_COLS + 1).collect()]
    if len(found) > MAX_DIRECT_COLS:
        raise ValueError("too many event types for a dense matrix")
    return sorted(found)


def user_event(spark: SparkSession, sf: str) -> TallMatrix:
    """Sum of values per user and event type (sorted by name)."""
    kinds = event_types(spark, sf)
    code = F.array_position(F.lit(kinds), F.col("event_type")) - 1
    return pivot_sum(table(spark, sf, "events"), F.col("user_id"), code, F.col("value"), len(kinds))


def user_event_count(spark: SparkSession, sf: str) -> TallMatrix:
    kinds = event_types(spark, sf)
    code = F.array_position(F.lit(kinds), F.col("event_type")) - 1
    return pivot_sum(table(spark, sf, "events"), F.col("user_id"), code, F.lit(1.0), len(kinds))


def part_nation(spark: SparkSession, sf: str) -> TallMatrix:
    """Quantity per part and supplier nation."""
    lines = table(spark, sf, "lineitem")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).groupBy("l_partkey", "s_nationkey")
    # a part has at most a record per nation now; dealt by part, so that no task makes wide sums for nearly all parts
    joined = joined.agg(F.sum("l_quantity").alias("quantity")).repartition("l_partkey")
    return pivot_sum(
        joined, F.col("l_partkey"), F.col("s_nationkey"), F.col("quantity"), NATIONS
    )


def supp_month(spark: SparkSession, sf: str) -> TallMatrix:
    """Quantity per supplier and calendar month of shipping."""
    lines = table(spark, sf, "lineitem")
    return pivot_sum(
        lines, F.col("l_suppkey"), F.month("l_shipdate") - 1, F.col("l_quantity"), MONTHS
    )


def cust_prio(spark: SparkSession, sf: str) -> TallMatrix:
    """Order value per customer and priority, in thousands."""
    orders = table(spark, sf, "orders")
    code = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    value = F.col("o_totalprice") / 1000.0
    return pivot_sum(orders, F.col("o_custkey"), code, value, PRIORITIES)


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def order_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Four sums per order as wide double columns."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row_id"))
    return lines.agg(*[F.sum(m).alias(m) for m in MEASURES])


def order4(spark: SparkSession, sf: str) -> TallMatrix:
    return TallMatrix.from_columns(order_measures(spark, sf), MEASURES)


def emb(spark: SparkSession, sf: str) -> TallMatrix:
    df = table(spark, sf, "embeddings")
    return TallMatrix.from_arrays(df, EMBEDDING, "vec_id", "embedding")


def supplier_count(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "supplier").agg(F.max("s_suppkey")).first()[0] + 1


def part_supp(spark: SparkSession, sf: str) -> CooMatrix:
    """Quantity per part and supplier, sparse."""
    lines = table(spark, sf, "lineitem")
    entries = lines.select(
        F.col("l_partkey").alias("row_id"),
        F.col("l_suppkey").alias("col_id"),
        F.col("l_quantity").alias("val"),
    )
    return CooMatrix(entries, supplier_count(spark, sf))


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """A latitude per supplier, as (row_id, lat)."""
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("row_id"), (key * 37 % 181 - 90).cast("double").alias("lat")
    )


# -- the same in SQL ----------------------------------------------------------


def _dense(name: str, entries: str, cols: str) -> str:
    return f"""{name}_e AS MATERIALIZED ({entries}),
{name} AS MATERIALIZED (
  SELECT r.row_id, c.col_id, coalesce(e.val, 0.0) AS val
  FROM (SELECT DISTINCT row_id FROM {name}_e) r CROSS JOIN ({cols}) c
  LEFT JOIN {name}_e e ON e.row_id = r.row_id AND e.col_id = c.col_id)"""


def _numbers(n: int) -> str:
    return f"SELECT unnest(range({n})) AS col_id"


_KINDS = """SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS col_id
  FROM (SELECT DISTINCT event_type FROM events)"""

SQL = {
    "user_event": _dense(
        "user_event",
        f"""SELECT user_id AS row_id, k.col_id, sum(value) AS val
  FROM events JOIN ({_KINDS}) k USING (event_type) GROUP BY 1, 2""",
        f"SELECT col_id FROM ({_KINDS})",
    ),
    "user_event_count": _dense(
        "user_event_count",
        f"""SELECT user_id AS row_id, k.col_id, count(*)::DOUBLE AS val
  FROM events JOIN ({_KINDS}) k USING (event_type) GROUP BY 1, 2""",
        f"SELECT col_id FROM ({_KINDS})",
    ),
    "part_nation": _dense(
        "part_nation",
        """SELECT l_partkey AS row_id, s_nationkey::BIGINT AS col_id, sum(l_quantity) AS val
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
        _numbers(NATIONS),
    ),
    "supp_month": _dense(
        "supp_month",
        """SELECT l_suppkey AS row_id, month(l_shipdate) - 1 AS col_id, sum(l_quantity) AS val
  FROM lineitem GROUP BY 1, 2""",
        _numbers(MONTHS),
    ),
    "cust_prio": _dense(
        "cust_prio",
        """SELECT o_custkey AS row_id, substr(o_orderpriority, 1, 1)::BIGINT - 1 AS col_id,
         sum(o_totalprice / 1000.0) AS val
  FROM orders GROUP BY 1, 2""",
        _numbers(PRIORITIES),
    ),
    "order4": """order4 AS MATERIALIZED (
  SELECT l_orderkey AS row_id, c.col_id,
         sum(CASE c.col_id WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice
                           WHEN 2 THEN l_discount ELSE l_tax END) AS val
  FROM lineitem CROSS JOIN (SELECT unnest(range(4)) AS col_id) c GROUP BY 1, 2)""",
    "emb": """emb AS MATERIALIZED (
  SELECT vec_id AS row_id, unnest(range(64)) AS col_id,
         unnest(embedding)::DOUBLE AS val
  FROM embeddings)""",
    "part_supp": """part_supp AS MATERIALIZED (
  SELECT l_partkey AS row_id, l_suppkey AS col_id, sum(l_quantity) AS val
  FROM lineitem GROUP BY 1, 2)""",
    "latitude": """latitude AS (
  SELECT s_suppkey AS row_id, (s_suppkey * 37 % 181 - 90)::DOUBLE AS lat FROM supplier)""",
}


def with_matrices(*names: str) -> str:
    """`WITH RECURSIVE` and the CTEs of the named matrices."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)


def gram_sql(name: str, source: str) -> str:
    """CTE name(i, j, g) of A'A."""
    return f"""{name} AS MATERIALIZED (
  SELECT a.col_id AS i, b.col_id AS j, sum(a.val * b.val) AS g
  FROM {source} a JOIN {source} b ON a.row_id = b.row_id GROUP BY 1, 2)"""


def top_eigen_sql(gram: str, k: int, squarings: int = 16) -> str:
    """CTEs v0..v{k-1}(i, x) and l0..l{k-1}(lam): leading eigenpairs of gram(i, j, g).

    The matrix is squared and scaled again and again, which amounts to 2^squarings
    rounds of power iteration, so that close eigenvalues are told apart too. A column
    of what remains is the eigenvector; its largest entry is made positive. Then the
    pair is subtracted and the next one follows.
    """
    ctes = []
    for c in range(k):
        source = gram if c == 0 else f"{gram}_d{c}"
        ctes.append(f"""p{c}(it, i, j, m) AS (
  SELECT 0, i, j, g / (SELECT sqrt(sum(g * g)) FROM {source}) FROM {source}
  UNION ALL
  SELECT a.it + 1, a.i, b.j,
         sum(a.m * b.m) / sqrt(sum(sum(a.m * b.m) * sum(a.m * b.m)) OVER ())
  FROM p{c} a JOIN p{c} b ON b.it = a.it AND b.i = a.j
  WHERE a.it < {squarings} GROUP BY a.it, a.i, b.j),
q{c} AS MATERIALIZED (SELECT i, j, m FROM p{c} WHERE it = {squarings}),
w{c} AS MATERIALIZED (
  SELECT i, m / sqrt(sum(m * m) OVER ()) AS x FROM q{c}
  WHERE j = (SELECT j FROM q{c} WHERE i = j ORDER BY m DESC, j LIMIT 1)),
v{c} AS MATERIALIZED (
  SELECT i, x * (SELECT sign(x) FROM w{c} ORDER BY round(abs(x), 9) DESC, i LIMIT 1) AS x
  FROM w{c}),
l{c} AS MATERIALIZED (
  SELECT sum(a.x * s.g * b.x) AS lam
  FROM {source} s JOIN v{c} a ON a.i = s.i JOIN v{c} b ON b.i = s.j)""")
        if c + 1 < k:
            ctes.append(f"""{gram}_d{c + 1} AS MATERIALIZED (
  SELECT s.i, s.j, s.g - l{c}.lam * a.x * b.x AS g
  FROM {source} s JOIN v{c} a ON a.i = s.i JOIN v{c} b ON b.i = s.j CROSS JOIN l{c})""")
    return ",\n".join(ctes)


def singular_sql(k: int) -> str:
    """(comp, s) from the CTEs of top_eigen_sql."""
    return " UNION ALL ".join(f"SELECT {c}::BIGINT AS comp, sqrt(lam) AS s FROM l{c}" for c in range(k))


def vectors_sql(k: int) -> str:
    """(comp, i, x) from the CTEs of top_eigen_sql."""
    return " UNION ALL ".join(f"SELECT {c}::BIGINT AS comp, i, x FROM v{c}" for c in range(k))
