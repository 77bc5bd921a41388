"""Reading and storing tables, shared by the operators of this package."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.session import cut_lineage, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where there is one."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text) alone, whatever other columns there are; rows without an id are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).where(
        "doc_id IS NOT NULL"
    )


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read from there: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Sent:
    """An object of this library for tasks: broadcast as bytes that carry its classes along, so workers need no package."""

    def __init__(self, spark: SparkSession, value: Any):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value: Any = None

    def __getstate__(self) -> dict:
        return {"_bytes": self._bytes, "_value": None}

    @property
    def value(self) -> Any:
        if self._value is None:
            self._value = pickle.loads(self._bytes.value)
        return self._value


def crc32_remainder(divisor: int, column: str = "doc_id"):
    """crc32 of the id's decimal digits, modulo the divisor."""
    return F.expr(f"CAST(crc32(CAST({column} AS STRING)) % {divisor} AS INT)")


__all__ = ["ORACLES", "QUERIES", "Query", "Sent", "crc32_remainder", "cut_lineage", "query", "stored", "table", "texts_of"]
