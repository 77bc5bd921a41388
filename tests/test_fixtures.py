"""How the matrices of the queries are derived."""

import re

import duckdb

from tallmat.plans import fixtures as fx


def test_parts_meet_before_their_wide_sums(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT (i % 7)::BIGINT l_partkey, (i % 5)::BIGINT l_suppkey, i::DOUBLE l_quantity FROM range(70) r(i)) TO '{tmp_path}/lineitem.parquet'")
    con.sql(f"COPY (SELECT i::BIGINT s_suppkey, (i // 2)::INT s_nationkey FROM range(5) r(i)) TO '{tmp_path}/supplier.parquet'")
    a = fx.part_nation(spark, str(tmp_path))
    plan = a.df._jdf.queryExecution().executedPlan().toString()
    # two exchanges, and after the one by part alone none
    keys = [m.split(", ") for m in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]
    assert [len(k) for k in keys] == [2, 3] and keys[0][0].startswith("l_partkey")
    got = {r.row_id: r.v for r in a.df.collect()}
    want = {p: [sum(i for i in range(70) if i % 7 == p and i % 5 // 2 == n) for n in range(fx.NATIONS)] for p in range(7)}
    assert got == want
