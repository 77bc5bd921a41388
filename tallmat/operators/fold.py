"""One pass over the rows that adds up a small matrix.

Each task folds its Arrow batches into a partial matrix. The partials meet in a
tree of grouped merges that stream one partial after the other, so neither a task
nor the driver holds more than one merged matrix and one partial.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.session import MAX_LOCAL_ELEMS, PART_ELEMS

# A sum of up to this many elements is merged by a built-in aggregate.
SMALL_SUM = 1 << 12

# Partials that one task of a merge level takes; fewer where factoring two of them is the costly part.
FAN_IN = 64
COSTLY_FAN_IN = 4

# A matrix of up to this size travels with the task function.
CLOSURE_BYTES = 1 << 16

PART_SCHEMA = "slot INT, block INT, rows INT, part BINARY"

Part = tuple[int, np.ndarray]


def pack(slot: int, parts: Iterable[Part]) -> Iterator[pa.RecordBatch]:
    for block, x in parts:
        yield pa.RecordBatch.from_pydict(
            {
                "slot": pa.array([slot], pa.int32()),
                "block": pa.array([block], pa.int32()),
                "rows": pa.array([x.shape[0]], pa.int32()),
                "part": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()),
            }
        )


def unpack(batch) -> Iterator[Part]:
    blocks = batch.column("block").to_pylist()
    rows = batch.column("rows").to_pylist()
    for block, r, part in zip(blocks, rows, batch.column("part")):
        yield block, np.frombuffer(part.as_buffer(), dtype=np.float64).reshape(r, -1)


def merge_levels(parts: int, fan: int) -> int:
    """Levels of a tree with this fan-in over about `parts` partials."""
    levels = 1
    while parts > fan:
        parts, levels = math.ceil(parts / fan), levels + 1
    return levels


def expected_parts(df: DataFrame) -> int:
    """About how many tasks read the table: its files, or the shuffle partitions of the session if those are more.

    Only the depth of the merge tree follows from it, never the tasks of the scan.
    """
    return max(len(df.inputFiles()), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def merge_parts(parts: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], count: int, costly: bool = False) -> DataFrame:
    """One merged partial per block of about `count` partials each (PART_SCHEMA), by a tree of grouped merges."""

    def merge_group(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        merged = None
        for batch in batches:
            for _, x in unpack(batch):
                merged = x if merged is None else merge(merged, x)
        if merged is not None:
            yield from pack(key[0].as_py(), [(key[1].as_py(), merged)])

    fan = COSTLY_FAN_IN if costly else FAN_IN
    levels = merge_levels(count, fan)
    for level in range(levels):
        # neighbours meet, so no level but the last takes more than the fan-in, however many tasks there were
        slot = F.floor(F.col("slot") / fan).cast("int") if level < levels - 1 else F.lit(0)
        parts = parts.withColumn("slot", slot).groupBy("slot", "block").applyInArrow(merge_group, schema=PART_SCHEMA)
    return parts


def fold(
    df: DataFrame,
    local: Callable[[Iterator], Iterable[Part]],
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray],
    costly: bool = False,
) -> DataFrame:
    """(block, rows, part): the merged partials of `local`, one record per block.

    The scan keeps its own tasks. `costly` merges take more time than the exchange between two levels of the tree.
    """

    def run(batches):
        yield from pack(TaskContext.get().partitionId(), local(batches))

    parts = merge_parts(df.mapInArrow(run, PART_SCHEMA), merge, expected_parts(df), costly)
    return parts.select("block", "rows", "part")


class MatrixSum:
    """The sum over all tasks of the n_rows x n_cols matrices that `local(batches)` returns.

    `local` returns None for a task without rows. A small sum is emitted element by
    element and added up by a built-in aggregate; a larger one travels in blocks of
    rows (see block_rows) through the merge tree.
    """

    def __init__(self, df: DataFrame, local, n_rows: int, n_cols: int):
        self.n_rows, self.n_cols = n_rows, n_cols
        self.small = n_rows * n_cols <= SMALL_SUM
        if self.small:

            def elements(batches):
                x = local(batches)
                if x is not None:
                    yield element_batch(np.ascontiguousarray(x).reshape(-1))

            parts = df.mapInArrow(elements, "pos BIGINT, val DOUBLE")
            self.parts = parts.groupBy("pos").agg(F.sum("val").alias("val"))
        else:
            step = block_rows(n_cols)

            def blocks(batches):
                x = local(batches)
                if x is not None:
                    for block, start in enumerate(range(0, n_rows, step)):
                        yield block, x[start : start + step]

            self.parts = fold(df, blocks, np.add)

    def to_rows(self) -> DataFrame:
        """(row_id, v), without visiting the driver."""
        if not self.small:
            return parts_to_rows(self.parts, self.n_cols)
        row = F.floor(F.col("pos") / self.n_cols).alias("row_id")
        # n_cols elements per row
        rows = self.parts.groupBy(row).agg(
            F.sort_array(F.collect_list(F.struct("pos", "val"))).alias("e")
        )
        return rows.select("row_id", F.col("e.val").alias("v"))

    def to_numpy(self) -> np.ndarray:
        """One local matrix, for bounded sizes only."""
        if not self.small:
            return parts_to_numpy(self.parts, self.n_rows, self.n_cols)
        sums = self.parts.toArrow()
        if sums.num_rows == 0:
            raise ValueError("the matrix has no rows")
        x = np.empty(self.n_rows * self.n_cols)
        x[sums.column("pos").to_numpy()] = sums.column("val").to_numpy()
        return x.reshape(self.n_rows, self.n_cols)


def element_batch(values: np.ndarray) -> pa.RecordBatch:
    pos = pa.array(np.arange(len(values), dtype=np.int64))
    return pa.RecordBatch.from_arrays([pos, pa.array(values)], names=["pos", "val"])


def block_rows(n_cols: int) -> int:
    return max(1, PART_ELEMS // n_cols)


def parts_to_rows(parts: DataFrame, n_cols: int) -> DataFrame:
    """Merged blocks of rows as matrix rows (row_id, v)."""
    from tallmat.frames import ROW_SCHEMA
    from tallmat.operators import batches as codec

    step = block_rows(n_cols)

    def run(batches):
        for batch in batches:
            for block, x in unpack(batch):
                ids = pa.array(block * step + np.arange(x.shape[0], dtype=np.int64))
                yield codec.rows_batch(ids, x)

    return parts.mapInArrow(run, ROW_SCHEMA)


def parts_to_numpy(parts: DataFrame, n_rows: int, n_cols: int) -> np.ndarray:
    """Merged blocks of rows as one local matrix, for bounded sizes only."""
    check_local(n_rows, n_cols)
    blocks = [part for batch in parts.toArrow().to_batches() for part in unpack(batch)]
    if not blocks:
        raise ValueError("the matrix has no rows")
    return np.concatenate([x for _, x in sorted(blocks, key=lambda b: b[0])])


def fits_locally(rows: int, cols: int) -> bool:
    return rows * cols <= MAX_LOCAL_ELEMS


def check_local(rows: int, cols: int) -> None:
    if not fits_locally(rows, cols):
        raise ValueError(f"a {rows} x {cols} matrix is too large to hold in one process")


class Shipped:
    """A small matrix for use in tasks: part of the closure if tiny, else broadcast."""

    def __init__(self, spark: SparkSession, x: np.ndarray):
        check_local(*x.shape)
        tiny = x.nbytes <= CLOSURE_BYTES
        self._x = x if tiny else None
        self._broadcast = None if tiny else spark.sparkContext.broadcast(x)

    def __call__(self) -> np.ndarray:
        return self._broadcast.value if self._x is None else self._x

    def release(self) -> None:
        """Drop the copies, once every job that uses the matrix is done."""
        if self._broadcast is not None:
            self._broadcast.destroy()


def ship(spark: SparkSession, x: np.ndarray) -> Shipped:
    return Shipped(spark, x)
