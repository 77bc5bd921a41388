"""Named queries over the test tables, each with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix, TallMatrix

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def rounded(df: DataFrame, scale: float = 1.0, digits: int = 6, *cols: str) -> DataFrame:
    """Round value columns (`val` when none is named); + 0.0 turns -0 into 0."""
    for c in cols or ("val",):
        df = df.withColumn(c, F.round(F.col(c) / scale, digits) + F.lit(0.0))
    return df


def long(a: TallMatrix | CooMatrix, scale: float = 1.0, digits: int = 6) -> DataFrame:
    """(row_id, col_id, val) rounded; every element of a dense matrix, stored ones otherwise."""
    df = a.entries() if isinstance(a, TallMatrix) else a.df
    return rounded(df, scale, digits)


def sql_round(expr: str, scale: float = 1.0, digits: int = 6) -> str:
    return f"round(({expr}) / {scale:.1f}, {digits}) + 0.0"
