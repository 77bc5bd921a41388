"""Matrix sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix, TallMatrix
from tallmat.operators.pca import PcaModel
from tallmat.sources.index import Compacted
from tallmat.sources.readers import MM_HEADER


def write_matrix_market(entries: DataFrame, n_rows: int, n_cols: int, path: str) -> None:
    """1-based entries in full precision.

    The folder holds `0-header` (header and size line) and `1-entries` (any number of
    parts); their concatenation in name order is a regular file.
    """
    spark = entries.sparkSession
    text = F.concat_ws(
        " ",
        (F.col("row_id") + 1).cast("string"),
        (F.col("col_id") + 1).cast("string"),
        F.col("val").cast("string"),
    )
    # counted while writing
    written = Observation()
    lines = entries.select(text.alias("value")).observe(written, F.count(F.lit(1)).alias("nnz"))
    lines.write.text(f"{path}/1-entries")
    nnz = written.get["nnz"]
    header = spark.createDataFrame([(f"{MM_HEADER}\n{n_rows} {n_cols} {nnz}",)], "value STRING")
    header.coalesce(1).write.text(f"{path}/0-header")


def write_tall_matrix_market(a: TallMatrix, n_rows: int, path: str) -> None:
    """Every element of a dense matrix with row ids in [0, n_rows)."""
    write_matrix_market(a.entries(), n_rows, a.n_cols, path)


def write_coo_csv(a: CooMatrix, path: str) -> None:
    """Lines `col,row,value`."""
    a.df.select("col_id", "row_id", "val").write.csv(path)


def write_rows(a: CooMatrix, path: str) -> None:
    """Sorted sparse rows as Parquet (segments of a row where the matrix is very wide)."""
    a.segments().write.parquet(path)


def write_dictionary(ids: DataFrame, key: str, number: str, path: str) -> None:
    """The keys as text, one per line, in the order of their numbers."""
    parts = ids.repartitionByRange(number).sortWithinPartitions(number)
    parts.select(F.col(key).cast("string")).write.text(path)


def save_compacted(c: Compacted, path: str) -> None:
    """The matrix and both dictionaries, for read_compacted."""
    write_rows(c.matrix, f"{path}/matrix")
    c.rows.write.parquet(f"{path}/rows")
    c.cols.write.parquet(f"{path}/cols")


def export_model(model: PcaModel, path: str) -> None:
    """Four Matrix Market folders: colEOFs = U, rowEOFs = V, evalEOFs = S, rowMeans.

    The folder names are fixed values. Row ids are taken as 0-based row numbers.
    """
    m = model.row_stats.agg(F.max("row_id")).first()[0] + 1
    write_tall_matrix_market(model.u, m, f"{path}/colEOFs")
    write_tall_matrix_market(model.v, model.meta["n"], f"{path}/rowEOFs")
    zero = F.lit(0).cast("bigint").alias("col_id")
    s = model.s.select(F.col("comp").alias("row_id"), zero, F.col("s").alias("val"))
    write_matrix_market(s, model.k, 1, f"{path}/evalEOFs")
    means = model.row_stats.select("row_id", zero, F.col("mean").alias("val"))
    write_matrix_market(means, m, 1, f"{path}/rowMeans")
