"""Sparse rows as an iteration passes over them: many rows to a record, in numpy's own bytes.

A record holds its rows' entries as values and places among the columns that it touches, so a pass neither decodes lists nor
sorts, and adds to no column without an entry. The records stay in memory (and on disk) until released.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallmat.frames import ROW_SCHEMA, CooMatrix, TallMatrix
from tallmat.operators import batches as codec
from tallmat.operators.fold import MatrixSum, Shipped, ship
from tallmat.session import MAX_LOCAL_ELEMS, keep

# Entries of one record, unless a single row has more.
RECORD_ENTRIES = 1 << 20

SCHEMA = "row_id ARRAY<BIGINT>, lengths BINARY, cols BINARY, place BINARY, val BINARY, m BINARY, d BINARY"


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def _record(piece: pa.Table, centered: bool) -> pa.RecordBatch:
    batch = piece.combine_chunks().to_batches()[0]
    if batch.column("idx").flatten().null_count:
        raise ValueError("entry with a NULL column id")
    _, at, vals = codec.sparse_block(batch)
    cols, place = np.unique(at, return_inverse=True)
    ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("row_id"))
    found = {"row_id": ids, "lengths": _bytes(batch.column("idx").value_lengths().to_numpy().astype(np.int32))}
    found |= {"cols": _bytes(cols.astype(np.int64)), "place": _bytes(place.astype(np.int32)), "val": _bytes(vals)}
    for c in ("m", "d"):
        found[c] = _bytes(batch.column(c).to_numpy()) if centered else pa.array([None], pa.binary())
    return pa.RecordBatch.from_pydict(found)


def _cuts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to RECORD_ENTRIES entries, one row at least."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + RECORD_ENTRIES, side="right")))
        yield start, stop
        start = stop


def _packed(batches: Iterator[pa.RecordBatch], centered: bool) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.RecordBatch] = []
    entries = 0
    for batch in batches:
        lengths = batch.column("idx").value_lengths().to_numpy().astype(np.int64)
        for start, stop in _cuts(lengths):
            more = int(lengths[start:stop].sum())
            if waiting and entries + more > RECORD_ENTRIES:
                yield _record(pa.Table.from_batches(waiting), centered)
                waiting, entries = [], 0
            waiting.append(batch.slice(start, stop - start))
            entries += more
    if entries:
        yield _record(pa.Table.from_batches(waiting), centered)


class _Block:
    """One record; `times` and `adjoint` take and give a column."""

    def __init__(self, record: dict):
        lengths = np.frombuffer(record["lengths"], np.int32)
        self.n_rows = len(lengths)
        self.rows = np.repeat(np.arange(self.n_rows), lengths)
        self.cols = np.frombuffer(record["cols"], np.int64)
        self.place = np.frombuffer(record["place"], np.int32).astype(np.intp)
        self.val = np.frombuffer(record["val"], np.float64)
        self.m, self.d = (None if record[c] is None else np.frombuffer(record[c], np.float64) for c in ("m", "d"))

    def times(self, b: np.ndarray, total: float) -> np.ndarray:
        """The rows times a column b of the given sum."""
        y = np.bincount(self.rows, self.val * b[self.cols][self.place], minlength=self.n_rows)
        return y if self.m is None else (y - self.m * total) * self.d

    def adjoint(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        """What the rows times y add to `cols`, and what every column has less."""
        y = y if self.m is None else y * self.d
        sums = np.bincount(self.place, self.val * y[self.rows], minlength=len(self.cols))
        return sums, 0.0 if self.m is None else float(self.m @ y)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, _Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            record = {name: batch.column(name)[i] for name in batch.schema.names}
            yield record, _Block({c: x.as_buffer() if x.is_valid else None for c, x in record.items() if c != "row_id"})


class PackedSparse:
    """A CooMatrix or a CenteredSparse for the products of a local iteration."""

    def __init__(self, a):
        rows = a.sparse_rows() if isinstance(a, CooMatrix) else a.rows
        centered = not isinstance(a, CooMatrix)
        self.n_cols = a.n_cols
        self.df: DataFrame = keep(rows.mapInArrow(lambda batches: _packed(batches, centered), SCHEMA))
        # a task of a pass takes several of the partitions, so that few sums travel
        self.tasks = 2 * self.df.sparkSession.sparkContext.defaultParallelism

    def times_local(self, b: np.ndarray) -> TallMatrix:
        get = ship(self.df.sparkSession, b)

        def run(batches):
            rhs = np.asfortranarray(get())
            ones = rhs.sum(axis=0)
            for record, block in _blocks(batches):
                y = np.stack([block.times(rhs[:, j], ones[j]) for j in range(rhs.shape[1])], axis=1)
                yield codec.rows_batch(record["row_id"].values, y)

        return TallMatrix(self.df.mapInArrow(run, ROW_SCHEMA), b.shape[1])

    def gram_times_local(self, b: np.ndarray) -> np.ndarray:
        n, k = b.shape
        get = ship(self.df.sparkSession, b)
        try:
            return self._gram_times(get, n, k)
        finally:
            get.release()

    def _gram_times(self, get: Shipped, n: int, k: int) -> np.ndarray:
        def local(batches):
            acc = None
            rhs = np.asfortranarray(get())
            ones, less = rhs.sum(axis=0), np.zeros(k)
            for _, block in _blocks(batches):
                acc = np.zeros((n, k), order="F") if acc is None else acc
                for j in range(k):
                    sums, shift = block.adjoint(block.times(rhs[:, j], ones[j]))
                    acc[block.cols, j] += sums
                    less[j] += shift
            return None if acc is None else acc - less

        passed = self.df.drop("row_id").coalesce(self.tasks)
        if self.tasks * n * k > MAX_LOCAL_ELEMS // 2:
            return MatrixSum(passed, local, n, k).to_numpy()

        def whole(batches):
            x = local(batches)
            if x is not None:
                yield pa.RecordBatch.from_arrays([_bytes(x)], names=["sums"])

        parts = passed.mapInArrow(whole, "sums BINARY").toArrow().column("sums")
        if not len(parts):
            raise ValueError("the matrix has no rows")
        total = np.zeros((n, k))
        for part in parts:
            total += np.frombuffer(part.as_buffer()).reshape(n, k)
        return total

    def release(self) -> None:
        self.df.unpersist()
