"""Dense matrices too wide for one record per row: blocks of columns, multiplied in numpy.

A record holds the values of one row in one block of columns. Records are dealt once over tiles, a block of columns times
a bucket of rows, and stay there: in every product only the other factor and the partial results move, each a small
share of the matrix (its width over the tile's side). The other factor is a table of rows, so no side is bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.frames import ROW_SCHEMA, TallMatrix
from tallmat.operators import batches as codec
from tallmat.operators.fold import PART_SCHEMA, check_local, merge_parts, pack, unpack
from tallmat.operators.products import local_rows
from tallmat.session import keep

# Sides of a tile: one holds 8 MiB.
WIDTH = 1024
TILE_ROWS = 1024


def _rows(table: pa.Table, column: str, width: int) -> np.ndarray:
    return codec.dense_block(table.column(column).combine_chunks(), width)


@dataclass
class _Columns:
    """Where the columns of a block lie; travels with the task functions."""

    n: int
    width: int

    def count(self, block: int) -> int:
        return min(self.width, self.n - block * self.width)

    def of(self, block: int, other: pa.Table, k: int) -> np.ndarray:
        """A factor's rows for the columns of a block, zeros where it has none."""
        out = np.zeros((self.count(block), k))
        out[other.column("id").to_numpy() - block * self.width] = _rows(other, "y", k)
        return out


def _by_row(ids: np.ndarray, other: pa.Table, k: int) -> np.ndarray:
    """A factor's rows for the rows of a tile, zeros where it has none."""
    have, y = other.column("id").to_numpy(), _rows(other, "y", k)
    out = np.zeros((len(ids), k))
    if len(have):
        order = np.argsort(have)
        have, y = have[order], y[order]
        at = np.minimum(np.searchsorted(have, ids), len(have) - 1)
        found = have[at] == ids
        out[found] = y[at[found]]
    return out


class BlockedMatrix:
    """`df(row_id, block, v[])` with v the columns [block * width, (block + 1) * width) of the row.

    An absent block of a row is zero. `n_rows` only sizes the tiles.
    """

    def __init__(self, df: DataFrame, n_cols: int, n_rows: int, width: int = WIDTH, tile_rows: int = TILE_ROWS):
        self.n_cols, self.width = n_cols, width
        self.n_blocks = math.ceil(n_cols / width)
        self.n_buckets = max(1, math.ceil(n_rows / tile_rows))
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tiled = df.select("row_id", F.col("block").cast("int").alias("block"), self._bucket(), "v")
        placed = tiled.repartition(parts, "block", "bucket").sortWithinPartitions("block", "bucket")
        self.df = keep(placed)
        self._users = 1

    @classmethod
    def from_tall(cls, a: TallMatrix, width: int = WIDTH, tile_rows: int = TILE_ROWS) -> BlockedMatrix:
        """Rows cut into slices inside the scan; the elements stay in arrays."""
        n = a.n_cols
        block = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(n / width) - 1))).alias("block")
        cut = a.df.select("row_id", "v", block)
        sliced = F.slice("v", F.col("block") * width + 1, F.least(F.lit(width), n - F.col("block") * width))
        return cls(cut.select("row_id", "block", sliced.alias("v")), n, a.count(), width, tile_rows)

    def _bucket(self, column: str = "row_id"):
        return F.pmod(F.xxhash64(column), F.lit(self.n_buckets)).cast("int").alias("bucket")

    def _by_tile(self, df: DataFrame, side: str):
        """A factor (row_id, v) keyed by column ids or by row ids, copied to the tiles that need it."""
        if side == "cols":
            block = F.floor(F.col("row_id") / self.width).cast("int").alias("block")
            bucket = F.explode(F.sequence(F.lit(0), F.lit(self.n_buckets - 1))).alias("bucket")
        else:
            block = F.explode(F.sequence(F.lit(0), F.lit(self.n_blocks - 1))).alias("block")
            bucket = self._bucket()
        return df.select(block, bucket, F.lit(side).alias("side"), F.col("row_id").alias("id"), F.col("v").alias("y"))

    def _tiles(self, *factors: DataFrame):
        other = factors[0]
        for more in factors[1:]:
            other = other.unionByName(more)
        return self.df.groupBy("block", "bucket").cogroup(other.groupBy("block", "bucket"))

    def times(self, b: TallMatrix) -> TallMatrix:
        """A B for b keyed by column id."""
        k, columns = b.n_cols, _Columns(self.n_cols, self.width)

        def multiply(key, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table({"row_id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64()))})
            block = key[0].as_py()
            y = _rows(left, "v", columns.count(block)) @ columns.of(block, right, k)
            return pa.Table.from_batches([codec.rows_batch(left.column("row_id").combine_chunks(), y)])

        partial = self._tiles(self._by_tile(b.df, "cols")).applyInArrow(multiply, ROW_SCHEMA)
        sums = partial.groupBy("row_id").agg(*[F.sum(F.col("v")[j]).alias(f"y{j}") for j in range(k)])
        return TallMatrix(sums.select("row_id", F.array(*[f"y{j}" for j in range(k)]).alias("v")), k)

    def transpose_times(self, b: TallMatrix) -> TallMatrix:
        """A'B for b keyed by row id."""
        k, columns = b.n_cols, _Columns(self.n_cols, self.width)

        def multiply(key, left: pa.Table, right: pa.Table) -> pa.Table:
            block, bucket = key[0].as_py(), key[1].as_py()
            if not left.num_rows:
                return pa.Table.from_batches(pack(bucket, [(block, np.zeros((0, k)))]))
            z = _rows(left, "v", columns.count(block)).T @ _by_row(left.column("row_id").to_numpy(), right, k)
            return pa.Table.from_batches(pack(bucket, [(block, z)]))

        partial = self._tiles(self._by_tile(b.df, "rows")).applyInArrow(multiply, PART_SCHEMA).where("rows > 0")
        merged = merge_parts(partial, np.add, self.n_buckets)

        def rows(batches):
            for batch in batches:
                for block, z in unpack(batch):
                    yield codec.rows_batch(pa.array(block * columns.width + np.arange(len(z), dtype=np.int64)), z)

        return TallMatrix(merged.mapInArrow(rows, ROW_SCHEMA), k)

    def gram_times(self, b: TallMatrix) -> TallMatrix:
        return self.transpose_times(self.times(b))

    def gram(self) -> TallMatrix:
        """A'A as an n x n table in one pass: in each bucket of rows every pair of blocks meets once."""
        count, columns = self.n_blocks, _Columns(self.n_cols, self.width)
        other = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("other")
        dealt = self.df.select("bucket", "row_id", "block", "v", other)
        low, high = F.least("block", "other"), F.greatest("block", "other")
        dealt = dealt.select("bucket", low.alias("low"), high.alias("high"), "row_id", "block", "v")

        def multiply(key: tuple[pa.Scalar, ...], tiles: pa.Table) -> pa.Table:
            bucket, low, high = (k.as_py() for k in key)
            block = tiles.column("block").to_numpy()
            left, right = (tiles.filter(pa.array(block == b)) for b in (low, high))
            if low == high:
                x = _rows(left, "v", columns.count(low))
                return pa.Table.from_batches(pack(bucket, [(low * count + high, x.T @ x)]))
            ids, ours, theirs = np.intersect1d(
                left.column("row_id").to_numpy(), right.column("row_id").to_numpy(), True, True
            )
            z = _rows(left.take(ours), "v", columns.count(low)).T @ _rows(right.take(theirs), "v", columns.count(high))
            return pa.Table.from_batches(pack(bucket, [(low * count + high, z)]))

        partial = dealt.groupBy("bucket", "low", "high").applyInArrow(multiply, PART_SCHEMA)
        merged = merge_parts(partial, np.add, self.n_buckets)

        def rows(batches):
            for batch in batches:
                for pair, z in unpack(batch):
                    low, high = divmod(pair, count)
                    for own, across, part in [(low, high, z)] + ([(high, low, z.T)] if low != high else []):
                        ids = pa.array(own * columns.width + np.arange(len(part), dtype=np.int64))
                        numbers = pa.array(np.full(len(part), across, np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [ids, numbers, codec.list_column(part)], names=["row_id", "block", "v"]
                        )

        # n values per row id
        slices = F.sort_array(F.collect_list(F.struct("block", "v"))).alias("p")
        whole = merged.mapInArrow(rows, "row_id LONG, block INT, v ARRAY<DOUBLE>").groupBy("row_id").agg(slices)
        return TallMatrix(whole.select("row_id", F.flatten(F.col("p.v")).alias("v")), self.n_cols)

    # -- with a local factor ------------------------------------------------

    def times_local(self, b: np.ndarray) -> TallMatrix:
        return self.times(local_rows(self.df.sparkSession, b))

    def gram_times_local(self, b: np.ndarray) -> np.ndarray:
        check_local(*b.shape)
        return filled(self.gram_times(local_rows(self.df.sparkSession, b)), self.n_cols)

    def squared_error(self, left: TallMatrix, right: TallMatrix) -> DataFrame:
        """One record `val`: ||A - L R'||^2 with L keyed by row id and R by column id, added up from residuals."""
        k, columns = left.n_cols, _Columns(self.n_cols, self.width)

        def residual(key, tile: pa.Table, other: pa.Table) -> pa.Table:
            block = key[0].as_py()
            side = other.column("side").to_numpy(zero_copy_only=False)
            of = {s: other.filter(pa.array(side == s)) for s in ("rows", "cols")}
            approximate = _by_row(tile.column("row_id").to_numpy(), of["rows"], k) @ columns.of(block, of["cols"], k).T
            x = _rows(tile, "v", columns.count(block)) if tile.num_rows else np.zeros((0, columns.count(block)))
            return pa.table({"val": [float(((x - approximate) ** 2).sum())]})

        factors = self._by_tile(left.df, "rows"), self._by_tile(right.df, "cols")
        return self._tiles(*factors).applyInArrow(residual, "val DOUBLE").agg(F.sum("val").alias("val"))

    # -- as the decompositions use it ----------------------------------------

    def keep(self) -> BlockedMatrix:
        """One more user of the tiles, which go when the last one releases them."""
        self._users += 1
        return self

    placed = keep

    def release(self) -> None:
        self._users -= 1
        if self._users == 0:
            self.df.unpersist()

    def column_ids(self) -> DataFrame:
        return self.df.sparkSession.range(self.n_cols).withColumnRenamed("id", "row_id")


def filled(x: TallMatrix, n: int) -> np.ndarray:
    """A table keyed by 0 .. n-1 as a local matrix; absent rows are zero."""
    check_local(n, x.n_cols)
    rows = x.df.toArrow()
    out = np.zeros((n, x.n_cols))
    out[rows.column("row_id").to_numpy()] = _rows(rows, "v", x.n_cols)
    return out
