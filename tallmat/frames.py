"""The two matrix tables: one record per row, or one record per stored entry."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallmat.functions import arrays
from tallmat.session import MAX_BROADCAST_ROWS, MAX_LOCAL_ELEMS, PART_ELEMS, is_kept, keep

ROW_SCHEMA = "row_id BIGINT, v ARRAY<DOUBLE>"
# Array types that numpy widens to double exactly as a cast does.
NUMPY_ARRAYS = ("array<float>", "array<double>", "array<int>", "array<smallint>", "array<tinyint>")


Blocks = tuple[DataFrame, Callable[[Any], Iterator[tuple[Any, np.ndarray]]]]


def _dense_blocks(n: int):
    from tallmat.operators.batches import dense_block

    def read(batch):
        yield batch.column("row_id"), dense_block(batch.column("v"), n)

    return read


def _sparse_blocks(n: int):
    from tallmat.operators.batches import scatter_blocks

    return lambda batch: scatter_blocks(batch, n)


class TallMatrix:
    """`df(row_id BIGINT, v ARRAY<DOUBLE>)` with `n_cols` doubles in every row."""

    def __init__(self, df: DataFrame, n_cols: int, blocks: Blocks | None = None):
        if n_cols < 1:
            raise ValueError("a matrix needs at least one column")
        self.df = df if df.columns == ["row_id", "v"] else df.select("row_id", "v")
        self.n_cols = n_cols
        self._blocks = blocks
        self._callers = False
        # the stored entries of a matrix that was sparse; products of wide ones skip the zeros
        self.sparse: CooMatrix | None = None

    def blocks(self) -> Blocks:
        """How tasks read the matrix: a table, and a function from its Arrow batches to
        pairs (row ids, numpy block). A preprocessed matrix names the raw table here, so
        that the preparation runs on whole blocks in the same task."""
        return self._blocks or (self.df, _dense_blocks(self.n_cols))

    # -- construction -----------------------------------------------------

    @classmethod
    def from_columns(cls, df: DataFrame, cols: Sequence[str], row_id: str = "row_id"):
        """Wide numeric columns; every one must already be DOUBLE."""
        types = dict(df.dtypes)
        wrong = {c: types.get(c) for c in cols if types.get(c) != "double"}
        if wrong:
            raise TypeError(f"columns must be double: {wrong}")
        v = arrays.finite(F.array(*cols))
        return cls(df.select(F.col(row_id).cast("bigint").alias("row_id"), v.alias("v")), len(cols))

    @classmethod
    def from_arrays(
        cls, df: DataFrame, n_cols: int | None = None, row_id: str = "row_id", v: str = "v"
    ):
        """An array column of any numeric type. Counts the columns when not told."""
        raw = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(v).alias("v"))
        df = raw.select("row_id", arrays.finite(F.col("v").cast("array<double>")).alias("v"))
        if n_cols is None:
            low, high = df.select(F.min(F.size("v")), F.max(F.size("v"))).first()
            if high is None:
                raise ValueError("cannot count the columns of an empty table")
            if low != high:
                raise ValueError(f"rows have between {low} and {high} values")
            n_cols = high
        if dict(raw.dtypes)["v"] in NUMPY_ARRAYS:
            # tasks widen and check whole blocks
            return cls(df, n_cols, blocks=(raw, _dense_blocks(n_cols)))
        return cls(df, n_cols)

    # -- shape and placement ----------------------------------------------

    def dims(self) -> DataFrame:
        """One record: n_rows, n_cols, n_elements. Ragged rows raise."""
        n = self.n_cols
        ragged = F.max(F.when(F.size("v") != n, F.raise_error("ragged rows").cast("int")))
        counted = self.df.agg(F.count("*").alias("n_rows"), ragged.alias("ragged"))
        return counted.select(
            "n_rows",
            F.lit(n).cast("bigint").alias("n_cols"),
            (F.col("n_rows") * n + F.coalesce("ragged", F.lit(0))).alias("n_elements"),
        )

    def count(self) -> int:
        return self.df.count()

    def keep(self) -> TallMatrix:
        """A copy that stays in memory. Releasing it leaves a cache alone that was there before."""
        before = is_kept(self.df)
        kept = TallMatrix(keep(self.df), self.n_cols)
        kept._callers = before
        return kept

    def release(self) -> None:
        if not self._callers:
            self.df.unpersist()

    def coalesce(self, parts: int) -> TallMatrix:
        return TallMatrix(self.df.coalesce(parts), self.n_cols)

    def placed(self, parts: int) -> TallMatrix:
        """Partitioned by row id. Matrices kept with the same `parts` combine without
        another shuffle."""
        return TallMatrix(self.df.repartition(parts, "row_id"), self.n_cols)

    def to_numpy(self, max_elems: int = MAX_LOCAL_ELEMS) -> np.ndarray:
        """The whole matrix ordered by row_id, refused above `max_elems` values."""
        most = max_elems // self.n_cols
        rows = self.df.limit(most + 1).toArrow()
        if rows.num_rows > most:
            raise ValueError(f"more than {max_elems} elements; keep the matrix distributed")
        rows = rows.sort_by("row_id").column("v").combine_chunks()
        return rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.n_cols)

    # -- element-wise algebra ---------------------------------------------

    def with_v(self, v: Column, n_cols: int | None = None) -> TallMatrix:
        return TallMatrix(self.df.select("row_id", v.alias("v")), n_cols or self.n_cols)

    def map_elements(self, f: Callable[[Column], Column]) -> TallMatrix:
        return self.with_v(F.transform("v", f))

    def __add__(self, other) -> TallMatrix:
        if isinstance(other, TallMatrix):
            return self._zip(other, lambda a, b: a + b)
        return self.map_elements(lambda x: x + float(other))

    def __sub__(self, other) -> TallMatrix:
        if isinstance(other, TallMatrix):
            return self._zip(other, lambda a, b: a - b)
        return self.map_elements(lambda x: x - float(other))

    def __mul__(self, by: float) -> TallMatrix:
        return self.map_elements(lambda x: x * float(by))

    def __truediv__(self, by: float) -> TallMatrix:
        if by == 0:
            raise ZeroDivisionError("matrix divided by 0")
        return self.map_elements(lambda x: x / float(by))

    def __pow__(self, power: float) -> TallMatrix:
        return self.map_elements(lambda x: F.pow(x, F.lit(float(power))))

    def _zip(self, other: TallMatrix, f) -> TallMatrix:
        if self.n_cols != other.n_cols:
            raise ValueError(f"{self.n_cols} columns against {other.n_cols}")
        left = self.df.withColumnRenamed("v", "a")
        right = other.df.withColumnRenamed("v", "b")
        both = left.join(right, "row_id", "full_outer")
        unmatched = F.col("a").isNull() | F.col("b").isNull()
        failure = F.raise_error("row ids of the two matrices differ").cast("array<double>")
        v = F.when(unmatched, failure).otherwise(F.zip_with("a", "b", f))
        return TallMatrix(both.select("row_id", v.alias("v")), self.n_cols)

    # -- slices, always half-open -----------------------------------------

    def row_slice(self, start: int, stop: int) -> TallMatrix:
        inside = (F.col("row_id") >= start) & (F.col("row_id") < stop)
        return TallMatrix(self.df.where(inside), self.n_cols)

    def col_slice(self, start: int, stop: int) -> TallMatrix:
        if not 0 <= start < stop <= self.n_cols:
            raise IndexError(f"columns [{start}, {stop}) of {self.n_cols}")
        return self.with_v(F.slice("v", start + 1, stop - start), stop - start)

    def slice(self, rows: tuple[int, int], cols: tuple[int, int]) -> TallMatrix:
        return self.row_slice(*rows).col_slice(*cols)

    def gather(self, cols: Sequence[int]) -> TallMatrix:
        """The chosen columns in the given order."""
        for j in cols:
            if not 0 <= j < self.n_cols:
                raise IndexError(f"column {j} of {self.n_cols}")
        return self.with_v(F.array(*[F.col("v")[int(j)] for j in cols]), len(cols))

    # -- other views --------------------------------------------------------

    def entries(self) -> DataFrame:
        """Every element as (row_id, col_id, val)."""
        exploded = self.df.select("row_id", F.posexplode("v").alias("pos", "val"))
        return exploded.select("row_id", F.col("pos").cast("bigint").alias("col_id"), "val")

    def to_coo(self) -> CooMatrix:
        nonzero = self.entries().where(F.col("val") != 0)
        a = CooMatrix(nonzero, self.n_cols, canonical=True)
        # the sparse rows come from the dense ones without a shuffle
        positions = F.sequence(F.lit(0).cast("bigint"), F.lit(self.n_cols - 1).cast("bigint"))
        rows = self.df.select(
            "row_id",
            F.filter(positions, lambda i: F.get("v", i.cast("int")) != 0).alias("idx"),
            F.filter("v", lambda x: x != 0).alias("val"),
        )
        a._rows = rows.where(F.size("idx") > 0)
        return a


class CooMatrix:
    """`df(row_id BIGINT, col_id BIGINT, val DOUBLE)`; absent entries are 0.

    Several records for one position are summed. Column ids lie in [0, n_cols);
    row ids may be any numbers.
    """

    def __init__(self, df: DataFrame, n_cols: int, canonical: bool = False):
        if n_cols < 1:
            raise ValueError("a matrix needs at least one column")
        df = df.select(
            F.col("row_id").cast("bigint").alias("row_id"),
            F.col("col_id").cast("bigint").alias("col_id"),
            F.col("val").cast("double").alias("val"),
        )
        if not canonical:
            # partial sums before the shuffle, so a hot row or column stays harmless
            df = df.groupBy("row_id", "col_id").agg(F.sum("val").alias("val"))
        self.df = df
        self.n_cols = n_cols
        self._rows: DataFrame | None = None
        self._callers = False

    @classmethod
    def from_segments(cls, rows: DataFrame, n_cols: int) -> CooMatrix:
        """Rows stored as segments() writes them; whole rows are used as they are."""
        pairs = rows.select("row_id", F.explode(F.arrays_zip("idx", "val")).alias("e"))
        entries = pairs.select("row_id", F.col("e.idx").alias("col_id"), F.col("e.val").alias("val"))
        a = cls(entries, n_cols, canonical=True)
        if n_cols <= PART_ELEMS:
            a._rows = rows.select("row_id", "idx", "val")
        return a

    def keep(self) -> CooMatrix:
        """A copy whose sparse rows stay in memory, for several passes over them."""
        kept = CooMatrix(self.df, self.n_cols, canonical=True)
        rows = self.sparse_rows()
        kept._callers = is_kept(rows)
        kept._rows = keep(rows)
        return kept

    def coalesce(self, parts: int) -> CooMatrix:
        fewer = CooMatrix(self.df.coalesce(parts), self.n_cols, canonical=True)
        fewer._rows = self.sparse_rows().coalesce(parts)
        return fewer

    def release(self) -> None:
        if self._rows is not None and not self._callers:
            self._rows.unpersist()

    def validated(self) -> CooMatrix:
        """The same matrix; NULL, NaN or a column id outside the range raises when read."""
        bad = (
            F.col("row_id").isNull()
            | F.col("val").isNull()
            | F.isnan("val")
            | ~F.coalesce(F.col("col_id").between(0, self.n_cols - 1), F.lit(False))
        )
        failure = F.raise_error("entry with NULL, NaN or a column id out of range").cast("double")
        checked = self.df.withColumn("val", F.when(bad, failure).otherwise(F.col("val")))
        return CooMatrix(checked, self.n_cols, canonical=True)

    def segments(self, width: int = PART_ELEMS) -> DataFrame:
        """Rows as sorted (row_id, segment, idx[], val[]).

        A segment covers `width` columns, so no record grows with the length of a
        row. A matrix of up to `width` columns has one segment per row.
        """
        segment = F.floor(F.col("col_id") / width).alias("segment")
        grouped = self.df.groupBy("row_id", segment).agg(
            F.sort_array(F.collect_list(F.struct("col_id", "val"))).alias("e")
        )
        return grouped.select(
            "row_id", "segment", F.col("e.col_id").alias("idx"), F.col("e.val").alias("val")
        )

    def sparse_rows(self) -> DataFrame:
        """(row_id, idx[], val[]): whole rows, for matrices whose rows fit in a record."""
        if self.n_cols > MAX_LOCAL_ELEMS:
            raise ValueError(f"{self.n_cols} columns in one record; use segments()")
        if self._rows is not None:
            return self._rows
        return self.segments(self.n_cols).select("row_id", "idx", "val")

    def blocks(self) -> Blocks:
        """As TallMatrix.blocks: rows made dense inside the task, a bounded block at a time."""
        return self.sparse_rows(), _sparse_blocks(self.n_cols)

    def squared_norm(self) -> DataFrame:
        """One record `val`: the sum of squares."""
        return self.df.agg(F.sum(F.col("val") * F.col("val")).alias("val"))

    def row_slice(self, start: int, stop: int) -> CooMatrix:
        inside = (F.col("row_id") >= start) & (F.col("row_id") < stop)
        return CooMatrix(self.df.where(inside), self.n_cols, canonical=True)

    def col_slice(self, start: int, stop: int) -> CooMatrix:
        if not 0 <= start < stop <= self.n_cols:
            raise IndexError(f"columns [{start}, {stop}) of {self.n_cols}")
        inside = self.df.where((F.col("col_id") >= start) & (F.col("col_id") < stop))
        return CooMatrix(inside.withColumn("col_id", F.col("col_id") - start), stop - start, True)

    def gather(self, chosen: DataFrame, n_chosen: int) -> CooMatrix:
        """Columns named by `chosen(col_id, pos)`; pos becomes the new column id."""
        chosen = chosen.select("col_id", "pos")
        if n_chosen <= MAX_BROADCAST_ROWS:
            chosen = F.broadcast(chosen)
        picked = self.df.join(chosen, "col_id")
        return CooMatrix(picked.select("row_id", F.col("pos").alias("col_id"), "val"), n_chosen, True)

    def to_tall(self) -> TallMatrix:
        """Dense rows; a row without entries is absent here as well.

        Rows too long for a record raise when they are read; decompositions go on by the entries then.
        """
        from tallmat.operators import batches

        n = self.n_cols
        if n > MAX_LOCAL_ELEMS:
            failure = F.raise_error(F.lit(f"{n} columns are too many for dense rows")).cast("array<double>")
            tall = TallMatrix(self.df.select("row_id").distinct().select("row_id", failure.alias("v")), n)
            tall.sparse = self
            return tall

        def densify(record_batches):
            for batch in record_batches:
                for row_ids, x in batches.scatter_blocks(batch, n):
                    yield batches.rows_batch(row_ids, x)

        tall = TallMatrix(self.sparse_rows().mapInArrow(densify, ROW_SCHEMA), n)
        tall.sparse = self
        return tall
