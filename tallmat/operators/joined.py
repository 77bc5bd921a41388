"""Sparse products where the other factor is a table as well, so no side is bounded.

The entries are placed twice, by column and by row, and reused by every product of
an iteration; only the other factor and the partial sums move. Where the rows of the
other factor are as few as the columns of a narrow matrix, they go to all entries as
placed by row, so that the sums of a row are made where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallmat.frames import CooMatrix, TallMatrix
from tallmat.session import MAX_BROADCAST_ROWS, keep

# Sums per aggregation; wider factors are handled a slice at a time.
SLICE = 64


class _Placed:
    """Entries partitioned by one id, with frequent ids spread over several salts."""

    def __init__(self, entries: DataFrame, key: str, other: str, parts: int):
        counts = entries.groupBy(key).agg(F.count("*").alias("n"))
        total = entries.count()
        fair = max(1, total // (4 * parts))
        # fewer than 4 * parts + 1 ids can be this frequent
        fan = F.ceil(F.col("n") / fair).cast("int").alias("fan")
        self.hot = keep(counts.where(F.col("n") > fair).select(key, fan))
        self.key, self.other = key, other
        spread = F.pmod(F.xxhash64(other), F.coalesce("fan", F.lit(1)).cast("bigint")).cast("int")
        salted = entries.join(F.broadcast(self.hot), key, "left").withColumn("salt", spread)
        self.entries = keep(salted.drop("fan").repartition(parts, key, "salt"))

    def times(self, b: TallMatrix) -> TallMatrix:
        """Sum over entries of val * b[key], grouped by the other id."""
        return self._in_slices(b, self._times)

    def own_times(self, b: TallMatrix) -> TallMatrix:
        """Sum over entries of val * b[other id], grouped by the key, for a b that every task may hold."""
        return self._in_slices(b, self._own_times)

    def _in_slices(self, b: TallMatrix, product) -> TallMatrix:
        slices = [
            product(b, start, min(start + SLICE, b.n_cols))
            for start in range(0, b.n_cols, SLICE)
        ]
        out = slices[0]
        for more in slices[1:]:
            more = more.withColumnRenamed("v", "more")
            out = out.join(more, "row_id").select("row_id", F.concat("v", "more").alias("v"))
        return TallMatrix(out, b.n_cols)

    def _times(self, b: TallMatrix, start: int, stop: int) -> DataFrame:
        names = [f"y{j}" for j in range(stop - start)]
        flat: list[Column] = [F.col("v")[start + j].alias(c) for j, c in enumerate(names)]
        rhs = b.df.select(F.col("row_id").alias(self.key), *flat)
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1)).alias("salt")
        rhs = rhs.join(F.broadcast(self.hot), self.key, "left").select(self.key, copies, *names)
        matched = self.entries.join(rhs.hint("shuffle_hash"), [self.key, "salt"])
        sums = matched.groupBy(self.other).agg(
            *[F.sum(F.col("val") * F.col(c)).alias(c) for c in names]
        )
        return sums.select(F.col(self.other).alias("row_id"), F.array(*names).alias("v"))

    def _own_times(self, b: TallMatrix, start: int, stop: int) -> DataFrame:
        names = [f"y{j}" for j in range(stop - start)]
        flat: list[Column] = [F.col("v")[start + j].alias(c) for j, c in enumerate(names)]
        rhs = b.df.select(F.col("row_id").alias(self.other), *flat)
        sums = self.entries.join(F.broadcast(rhs), self.other).groupBy(self.key).agg(
            *[F.sum(F.col("val") * F.col(c)).alias(c) for c in names]
        )
        return sums.select(F.col(self.key).alias("row_id"), F.array(*names).alias("v"))

    def release(self) -> None:
        self.entries.unpersist()
        self.hot.unpersist()


class JoinedMatrix:
    """A sparse matrix ready for repeated products with tables of any length."""

    def __init__(self, a: CooMatrix):
        self._parts = int(a.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.n_cols = a.n_cols
        source = keep(a.df)
        self._by_row = _Placed(source, "row_id", "col_id", self._parts)
        self._col: _Placed | None = None
        self._by_row.entries.count()
        source.unpersist()

    def _narrow(self, k: int) -> bool:
        """Whether n_cols rows of k values and an id are few enough for every task."""
        return self.n_cols * (k + 1) <= MAX_BROADCAST_ROWS

    @property
    def _by_col(self) -> _Placed:
        """Placed when a product first needs it."""
        if self._col is None:
            self._col = _Placed(self._by_row.entries.drop("salt"), "col_id", "row_id", self._parts)
            self._col.entries.count()
        return self._col

    def times(self, b: TallMatrix) -> TallMatrix:
        """A B for b keyed by column id; rows of A without entries are absent."""
        if self._narrow(min(b.n_cols, SLICE)):
            return self._by_row.own_times(b)
        return self._by_col.times(b)

    def transpose_times(self, b: TallMatrix) -> TallMatrix:
        """A'B for b keyed by row id."""
        return self._by_row.times(b)

    def gram_times(self, b: TallMatrix) -> TallMatrix:
        return self.transpose_times(self.times(b))

    def column_ids(self) -> DataFrame:
        return self._by_row.entries.select(F.col("col_id").alias("row_id")).distinct()

    def release(self) -> None:
        for held in (self._col, self._by_row):
            if held is not None:
                held.release()
