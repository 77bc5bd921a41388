"""Dense 0-based numbering of keys, and the replacement of keys by their numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix
from tallmat.session import MAX_BROADCAST_ROWS, cut_lineage, keep

_POSITION_BITS = 33


def number_rows(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """The rows with a column `name` counting from 0 in the given order, and their count.

    The rows are range partitioned and written once, so that a row's place in its
    partition is settled; a partition's first number comes from the sizes of those
    before it.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _POSITION_BITS).alias("_part")
    position = F.col("_at").bitwiseAND((1 << _POSITION_BITS) - 1)

    # one record per partition
    sizes = placed.groupBy(part).count().orderBy("_part").collect()
    first, offsets = 0, []
    for row in sizes:
        offsets.append((row["_part"], first))
        first += row["count"]
    starts = F.broadcast(spark.createDataFrame(offsets, "_part BIGINT, _first BIGINT"))
    numbered = placed.withColumn("_part", part).join(starts, "_part")
    numbered = numbered.withColumn(name, F.col("_first") + position)
    return numbered.drop("_at", "_part", "_first"), first


@dataclass
class Compacted:
    """A matrix over dense ids with rows(row_key, row_id) and cols(col_key, col_id)."""

    matrix: CooMatrix
    rows: DataFrame
    cols: DataFrame


def compact(entries: DataFrame) -> Compacted:
    """Replace the keys of (row_key, col_key, val) by their place in the sorted keys."""
    # summed first, so that what is looked up holds every position once
    summed = keep(entries.groupBy("row_key", "col_key").agg(F.sum("val").alias("val")))
    rows, n_rows = number_rows(summed.select("row_key").distinct(), ["row_key"], "row_id")
    cols, n_cols = number_rows(summed.select("col_key").distinct(), ["col_key"], "col_id")
    found = replace_key(replace_key(summed, rows, n_rows, "row_key"), cols, n_cols, "col_key")
    matrix = CooMatrix(found.select("row_id", "col_id", "val"), n_cols, canonical=True)
    return Compacted(matrix, rows, cols)


def replace_key(entries: DataFrame, ids: DataFrame, n_ids: int, key: str) -> DataFrame:
    """Join a dictionary to the entries without piling a frequent key onto one task."""
    if n_ids <= MAX_BROADCAST_ROWS:
        return entries.join(F.broadcast(ids), key).drop(key)
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = entries.groupBy(key).agg(F.count("*").alias("n"))
    fair = max(1, entries.count() // (4 * parts))
    # at most 4 * parts keys are this frequent
    frequent = keep(counts.where(F.col("n") > fair).select(key))
    hot_ids = F.broadcast(ids.join(F.broadcast(frequent), key, "left_semi"))
    hot = entries.join(hot_ids, key)
    rest = entries.join(F.broadcast(frequent), key, "left_anti").join(ids, key)
    return hot.unionByName(rest).drop(key)
