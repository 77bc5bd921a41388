"""Matrix sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix, TallMatrix
from tallmat.functions import arrays
from tallmat.functions.noise import uniform
from tallmat.session import MAX_BROADCAST_ROWS
from tallmat.sources.index import number_rows

# A table of up to this many file paths is broadcast.
MAX_BROADCAST_FILES = 100_000

# fixed header line of the only supported Matrix Market kind
MM_HEADER = "%%MatrixMarket matrix coordinate real general"


# -- sparse entries -------------------------------------------------------


def read_coo_csv(
    spark: SparkSession, path: str, n_cols: int | None = None, unique: bool = False
) -> CooMatrix:
    """Lines `col,row,value`, column first. Malformed lines raise when read.

    `unique` says that no position occurs twice, which saves the summing shuffle.
    """
    raw = (
        spark.read.schema("col_id BIGINT, row_id BIGINT, val DOUBLE")
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return CooMatrix(raw, n_cols or _width(raw), canonical=unique).validated()


def _width(entries: DataFrame) -> int:
    highest = entries.agg(F.max("col_id")).first()[0]
    if highest is None:
        raise ValueError("cannot count the columns of an empty matrix")
    return highest + 1


def read_segments(spark: SparkSession, path: str, n_cols: int) -> CooMatrix:
    """Rows saved by write_rows; their positions are distinct, so nothing is shuffled."""
    return CooMatrix.from_segments(spark.read.parquet(path), n_cols)


def read_compacted(
    spark: SparkSession, path: str, n_rows: int = 0, n_cols: int = 0
) -> tuple[CooMatrix, int]:
    """A saved compacted matrix and its row count; a size of 0 is taken from the dictionary."""
    n_rows = n_rows or spark.read.parquet(f"{path}/rows").count()
    n_cols = n_cols or spark.read.parquet(f"{path}/cols").count()
    return read_segments(spark, f"{path}/matrix", n_cols), n_rows


# -- Matrix Market ----------------------------------------------------------


@dataclass
class MatrixMarket:
    entries: DataFrame
    n_rows: int
    n_cols: int
    nnz: int

    def coo(self) -> CooMatrix:
        return CooMatrix(self.entries, self.n_cols)


def _scan_matrix_market(spark: SparkSession, path: str) -> MatrixMarket:
    """Header, sizes and 0-based entries of a file, or of a folder of text parts."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"))
        .withColumn("at", F.monotonically_increasing_id())
    )
    head = lines.where(F.col("value").startswith("%%")).first()
    if head is None or head["value"].strip() != MM_HEADER:
        raise ValueError(f"{path} does not start with {MM_HEADER!r}")
    size = (
        lines.where((F.col("file") == head["file"]) & (F.col("at") > head["at"]))
        .where(~F.col("value").startswith("%"))
        .first()
    )
    if size is None or len(size["value"].split()) != 3:
        raise ValueError(f"{path} has no line 'rows columns entries'")
    n_rows, n_cols, nnz = (int(t) for t in size["value"].split())

    body = lines.where(~F.col("value").startswith("%") & (F.col("at") != size["at"]))
    tokens = F.split(F.trim("value"), r"\s+")
    message = F.concat(F.lit("expected 'row column value': "), F.col("value"))
    checked = F.when(F.size(tokens) == 3, tokens).otherwise(
        F.raise_error(message).cast("array<string>")
    )
    body = body.select(checked.alias("t"))
    entries = body.select(
        (F.col("t")[0].cast("bigint") - 1).alias("row_id"),
        (F.col("t")[1].cast("bigint") - 1).alias("col_id"),
        F.col("t")[2].cast("double").alias("val"),
    )
    return MatrixMarket(entries, n_rows, n_cols, nnz)


def read_matrix_market(spark: SparkSession, path: str) -> MatrixMarket:
    """Sparse scan; the number of entries must be the announced one."""
    matrix = _scan_matrix_market(spark, path)
    found = matrix.entries.count()
    if found != matrix.nnz:
        raise ValueError(f"{path} announces {matrix.nnz} entries and has {found}")
    return matrix


def read_matrix_market_checked(spark: SparkSession, path: str) -> MatrixMarket:
    """The sparse scan plus index bounds and no position given twice."""
    matrix = read_matrix_market(spark, path)
    inside = F.col("row_id").between(0, matrix.n_rows - 1) & F.col("col_id").between(
        0, matrix.n_cols - 1
    )
    outside, positions = (
        matrix.entries.groupBy("row_id", "col_id")
        .agg(F.count_if(~inside).alias("outside"))
        .agg(F.sum("outside"), F.count("*"))
        .first()
    )
    if outside:
        raise ValueError(f"{path} has {outside} entries outside the matrix")
    if positions != matrix.nnz:
        raise ValueError(f"{path} gives {matrix.nnz - positions} positions more than once")
    return matrix


# -- dense rows -------------------------------------------------------------


def read_manifest(spark: SparkSession, path: str, order_by: str | None = None) -> TallMatrix:
    """Lines `path column partitions`: Parquet datasets stacked in the order of the lines.

    Rows are numbered from 0. Without `order_by` they keep their place in their file,
    and a row's number is its place plus the rows of all files before it, which needs
    no shuffle. With `order_by` they follow that column inside each dataset.
    The first line's partition count is the one that holds.
    """
    # one line per dataset
    lines = [r.value.split() for r in spark.read.text(path).collect() if r.value.strip()]
    if not lines or any(len(line) != 3 for line in lines):
        raise ValueError(f"{path} must have lines 'path column partitions'")
    frames = []
    for number, (source, column, _) in enumerate(lines):
        df = spark.read.parquet(source)
        frames.append(
            df.select(
                F.lit(number).alias("file_no"),
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.row_index").alias("place"),
                (F.col(order_by) if order_by else F.lit(0)).alias("key"),
                arrays.finite(F.col(column).cast("array<double>")).alias("v"),
            )
        )
    stacked = frames[0]
    for df in frames[1:]:
        stacked = stacked.unionByName(df)
    if order_by:
        numbered, _ = number_rows(stacked, ["file_no", "key", "file", "place"], "row_id")
    else:
        numbered = _number_by_place(stacked)
    numbered = numbered.select("row_id", "v").coalesce(int(lines[0][2]))
    return TallMatrix.from_arrays(numbered)


def _number_by_place(stacked: DataFrame) -> DataFrame:
    sizes = stacked.groupBy("file_no", "file").count().orderBy("file_no", "file").collect()
    starts, first = [], 0
    for row in sizes:
        starts.append((row["file_no"], row["file"], first))
        first += row["count"]
    schema = "file_no INT, file STRING, first BIGINT"
    many = len(starts) > MAX_BROADCAST_FILES
    starts = stacked.sparkSession.createDataFrame(starts, schema)
    starts = starts if many else F.broadcast(starts)
    joined = stacked.join(starts, ["file_no", "file"])
    return joined.withColumn("row_id", F.col("first") + F.col("place"))


def read_dense(
    spark: SparkSession,
    path: str,
    columns: str | Sequence[str],
    row_id: str,
    partitions: int | None = None,
) -> TallMatrix:
    """One Parquet dataset: an array column, or a list of numeric columns."""
    df = spark.read.parquet(path)
    if partitions:
        df = df.repartition(partitions)
    if isinstance(columns, str):
        return TallMatrix.from_arrays(df, row_id=row_id, v=columns)
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    return TallMatrix.from_columns(df.select(row_id, *doubles), columns, row_id)


def from_blocks(blocks: DataFrame, n_cols: int) -> TallMatrix:
    """Blocks of consecutive rows (block_id, rows ARRAY<ARRAY<DOUBLE>>), in block order.

    Row numbers go on from block to block, so blocks may differ in height.
    """
    heights = blocks.select("block_id", F.size("rows").cast("bigint").alias("height"))
    starts, n_blocks = _running_start(heights, "block_id", "height")
    if n_blocks <= MAX_BROADCAST_ROWS:
        starts = F.broadcast(starts)
    rows = blocks.join(starts, "block_id").select(
        "first", F.posexplode("rows").alias("pos", "v")
    )
    rows = rows.select((F.col("first") + F.col("pos")).alias("row_id"), "v")
    return TallMatrix.from_arrays(rows, n_cols)


def _running_start(sizes: DataFrame, key: str, size: str) -> tuple[DataFrame, int]:
    """(key, first): the sum of `size` over all smaller keys, and the number of keys."""
    from pyspark.sql import Window

    ordered, count = number_rows(sizes, [key], "number")
    # consecutive keys share a bucket, so a window never spans the whole table
    bucket = F.floor(F.col("number") / 65536)
    ordered = ordered.withColumn("bucket", bucket)
    sums = ordered.groupBy("bucket").agg(F.sum(size).alias("total")).orderBy("bucket").collect()
    starts = np.concatenate([[0], np.cumsum([r["total"] for r in sums])])[:-1]
    pairs = [(r["bucket"], int(start)) for r, start in zip(sums, starts)]
    before = F.broadcast(ordered.sparkSession.createDataFrame(pairs, "bucket BIGINT, before BIGINT"))
    inside = Window.partitionBy("bucket").orderBy("number").rowsBetween(
        Window.unboundedPreceding, -1
    )
    within = F.coalesce(F.sum(size).over(inside), F.lit(0))
    placed = ordered.withColumn("within", within).join(before, "bucket")
    return placed.select(key, (F.col("before") + F.col("within")).alias("first")), count


# -- weights ----------------------------------------------------------------


def read_row_weights(spark: SparkSession, path: str) -> DataFrame:
    """Lines `row,weight` as (row_id, weight)."""
    return (
        spark.read.schema("row_id BIGINT, weight DOUBLE").option("mode", "FAILFAST").csv(path)
    )


def read_latitude_weights(spark: SparkSession, path: str) -> DataFrame:
    """Lines `row,latitude` in degrees as (row_id, weight) with weight sqrt(cos(latitude))."""
    raw = spark.read.schema("row_id BIGINT, lat DOUBLE").option("mode", "FAILFAST").csv(path)
    return raw.select("row_id", arrays.latitude_weight(F.col("lat")).alias("weight"))


# -- random matrices --------------------------------------------------------


def random_rows(row_ids: DataFrame, n_cols: int, seed: int, draw=uniform) -> TallMatrix:
    """One row of random values per id in `row_ids(row_id)`; the same under any partitioning."""

    def value(j: Column) -> Column:
        return draw(F.col("row_id"), j, seed)

    v = F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)), value)
    return TallMatrix(row_ids.select("row_id", v.alias("v")), n_cols)


def random_uniform(spark: SparkSession, n_rows: int, n_cols: int, parts: int, seed: int):
    """Exactly n_rows rows of U(0, 1) values."""
    return random_rows(spark.range(0, n_rows, 1, parts).toDF("row_id"), n_cols, seed)

