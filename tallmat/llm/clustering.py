"""Centroid clustering of integer vectors over a VA-file.

Every vector is also kept as an approximation: `BITS` bits per dimension name the cell its component lies in. Cell edges
follow the mean and deviation of each dimension over all vectors, and the outermost cells end at its least and greatest
value, so cells bound all components whatever their distribution. In a round, lookup tables with one entry per
(dimension, cell, centroid) turn approximations into an interval of each squared distance. A vector whose nearest
centroid follows from the intervals, for the centroids of this round and of the round before, and is the same in both,
changes no sum: its full components are not fetched. All others are joined with their components and move their part
of the sums from the old centroid to the new one. Sums are integers, so they are exact in any order.

Approximations and components lie in one cached table, placed by row number; a round reads the approximations alone and
then looks up the rows it needs without moving any vector. Nothing but the centroids, k x dimensions sums and the edges
reaches the driver.

Defined cases: rows without id, NULL vectors, vectors of another length and those with a NULL, NaN or infinite component
are left out. Rows with equal ids are vectors of their own. With fewer than k vectors each starts a cluster; without any
there are no rows. Ties go to the smaller cluster number, and a cluster that loses all its vectors keeps its centroid.
Components beyond 2^27 in magnitude raise, as their distances would not fit 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.llm.common import query, stored, table
from tallmat.session import keep

# Bits of an approximation per dimension: 1, 2, 4 or 8, so that cells fill whole bytes.
BITS = 4
LARGEST = 1 << 27
# Rows of an Arrow batch handled at once.
_STEP = 1 << 14
# Above every distance between components up to LARGEST.
_FAR = np.iinfo(np.int64).max


@dataclass
class Cells:
    """edges[d]: the first value of every cell but the first; low[d], high[d]: least and greatest component."""

    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bits: int


@dataclass
class Clustering:
    """vectors(vec_id, cluster, distance); centroids (k, dims); inertia per cluster."""

    vectors: DataFrame
    centroids: np.ndarray
    inertia: np.ndarray


def fit_cells(count: int, total: np.ndarray, squares: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> Cells:
    """Edges at equal steps of a normal distribution with the mean and deviation of each dimension."""
    mean = total / count
    deviation = np.sqrt(np.maximum(squares / count - mean * mean, 0.0))
    steps = np.array([NormalDist().inv_cdf(i / (1 << bits)) for i in range(1, 1 << bits)])
    edges = np.floor(mean[:, None] + deviation[:, None] * steps).astype(np.int64)
    return Cells(np.clip(edges, low[:, None], high[:, None]), low, high, bits)


def approximate(cells: Cells, x: np.ndarray) -> np.ndarray:
    """The packed cells of integer vectors, one row of bytes each."""
    per_byte = 8 // cells.bits
    out = np.zeros((len(x), -(-x.shape[1] // per_byte)), np.uint8)
    for d in range(x.shape[1]):
        cell = np.searchsorted(cells.edges[d], x[:, d], side="right").astype(np.uint8)
        out[:, d // per_byte] |= cell << np.uint8(cells.bits * (d % per_byte))
    return out


def distance_tables(cells: Cells, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest share of a byte's dimensions in the squared distance: (bytes, 256, centroids) each."""
    begin = np.concatenate([cells.low[:, None], cells.edges], axis=1)[:, :, None]
    end = np.concatenate([cells.edges - 1, cells.high[:, None]], axis=1)[:, :, None]
    m = centroids.T[:, None, :]
    near = np.maximum(np.maximum(begin - m, m - end), 0) ** 2
    far = np.maximum(np.abs(begin - m), np.abs(end - m)) ** 2
    per_byte = 8 // cells.bits
    byte = np.arange(256)
    n_bytes = -(-len(near) // per_byte)
    tables = []
    for one in (near, far):
        out = np.zeros((n_bytes, 256, len(centroids)), np.int64)
        for d in range(len(one)):
            out[d // per_byte] += one[d, (byte >> (cells.bits * (d % per_byte))) & ((1 << cells.bits) - 1)]
        tables.append(out)
    return tables[0], tables[1]


def possible(approximations: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(rows, centroids): where the centroid may be the nearest, that is where its interval reaches below all upper ends."""
    low = np.zeros((len(approximations), tables[0].shape[2]), np.int64)
    high = np.zeros_like(low)
    for b in range(approximations.shape[1]):
        at = approximations[:, b]
        low += tables[0][b][at]
        high += tables[1][b][at]
    return low <= high.min(axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest possible centroid, the smaller one on ties, and the squared distance."""
    distance = np.full(may.shape, _FAR)
    for j, m in enumerate(centroids):
        rows = np.flatnonzero(may[:, j])
        distance[rows, j] = ((x[rows] - m) ** 2).sum(axis=1)
    cluster = distance.argmin(axis=1)
    return cluster, distance[np.arange(len(x)), cluster]


def _parts(batches: Iterator) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _STEP):
            yield batch.slice(start, _STEP)


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    values = column.flatten() if pa.types.is_list(column.type) else None
    if values is None:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)
    return values.to_numpy(zero_copy_only=False).reshape(len(column), width)


def kept_vectors(df: DataFrame, dims: int, scale: int, vec_id: str, vector: str) -> DataFrame:
    """(row, vec_id, x): usable vectors as integers floor(scale * component), under row numbers that are stored."""
    usable = (F.size("e") == dims) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    raw = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e"))
    beyond = F.exists("e", lambda x: F.abs(x) * scale > LARGEST)
    failure = F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("array<bigint>")
    x = F.when(beyond, failure).otherwise(F.transform("e", lambda x: F.floor(x * scale)))
    rows = raw.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & usable)
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", x.alias("x")), "vectors")


def _statistics(rows: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of vectors; sum, sum of squares, least and greatest value of each dimension."""

    def run(batches):
        for part in _parts(batches):
            x = _matrix(part.column("x"), dims, np.int64)
            columns = [
                np.arange(dims), np.full(dims, len(x)), x.sum(axis=0), (x.astype(float) ** 2).sum(axis=0), x.min(axis=0), x.max(axis=0)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "n", "s", "q", "low", "high"])

    found = (
        rows.select("x").mapInArrow(run, "d LONG, n LONG, s LONG, q DOUBLE, low LONG, high LONG")
        .groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("q"), F.min("low"), F.max("high")).orderBy("d").collect()
    )  # one row per dimension
    if not found:
        return 0, *(np.zeros(dims, np.int64) for _ in range(4))
    _, n, s, q, low, high = (np.array(c) for c in zip(*found))
    return int(n[0]), s, q, low, high


def _changes(vectors: DataFrame, cells: Cells, before: np.ndarray | None, now: np.ndarray) -> np.ndarray:
    """What the sums and counts (the last column) of the clusters gain from `before` to `now`.

    Before the first centroids all vectors count as members of cluster 0.
    """
    k, dims = now.shape
    width = -(-dims // (8 // cells.bits))

    def masks(approximations, tables):
        first = np.zeros((len(approximations), k), bool)
        first[:, 0] = True
        return [first if t is None else possible(approximations, t) for t in tables]

    def both_tables():
        return [None if c is None else distance_tables(cells, c) for c in (before, now)]

    def scan(batches):
        tables = both_tables()
        for part in _parts(batches):
            old, new = masks(_matrix(part.column("cells"), width, np.uint8), tables)
            settled = (old.sum(axis=1) == 1) & (old == new).all(axis=1)
            yield part.select(["row"]).filter(pa.array(~settled))

    def move(batches):
        tables, change = both_tables(), np.zeros((k, dims + 1), np.int64)
        for part in _parts(batches):
            x = _matrix(part.column("x"), dims, np.int64)
            ones = np.column_stack([x, np.ones(len(x), np.int64)])
            for sign, may, centroids in zip((-1, 1), masks(_matrix(part.column("cells"), width, np.uint8), tables), (before, now)):
                cluster = may.argmax(axis=1) if centroids is None else nearest(x, centroids, may)[0]
                for j in np.unique(cluster):
                    change[j] += sign * ones[cluster == j].sum(axis=0)
        at = np.flatnonzero(change)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(change.reshape(-1)[at])], names=["at", "val"])

    touched = vectors.select("row", "cells").mapInArrow(scan, "row LONG")
    fetched = vectors.join(touched.hint("shuffle_hash"), "row").select("cells", "x")
    out = np.zeros(k * (dims + 1), np.int64)
    for r in fetched.mapInArrow(move, "at LONG, val LONG").groupBy("at").agg(F.sum("val").alias("val")).collect():
        out[r["at"]] = r["val"]  # at most k x (dims + 1) rows
    return out.reshape(k, dims + 1)


def cluster_vectors(
    df: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    salt: str = "3:",
    bits: int = BITS,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> Clustering:
    """k-means in integer arithmetic; the first centroids are the k vectors with the least sha256 of salt + id."""
    spark = df.sparkSession
    rows = kept_vectors(df, dims, scale, vec_id, vector)
    count, total, squares, low, high = _statistics(rows, dims)
    schema = "vec_id LONG, cluster INT, distance LONG"
    if count == 0:
        return Clustering(spark.createDataFrame([], schema), np.zeros((0, dims), np.int64), np.zeros(0, np.int64))
    cells = fit_cells(count, total, squares, low, high, bits)
    width = -(-dims // (8 // bits))

    def add_cells(batches):
        for part in _parts(batches):
            packed = approximate(cells, _matrix(part.column("x"), dims, np.int64))
            column = pa.array([p.tobytes() for p in packed], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, column], names=["row", "vec_id", "x", "cells"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.mapInArrow(add_cells, "row LONG, vec_id LONG, x ARRAY<BIGINT>, cells BINARY").repartition(parts, "row")
    vectors = keep(placed)
    try:
        digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
        first = rows.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()
        now, before = np.array([r.x for r in first], np.int64), None
        sums = np.zeros((len(now), dims + 1), np.int64)
        sums[0] = [*total, count]
        for _ in range(rounds):
            if before is None or (before != now).any():
                sums = sums + _changes(vectors, cells, before, now)
            n = sums[:, -1:]
            before, now = now, np.where(n > 0, sums[:, :-1] // np.maximum(n, 1), now)

        def assign(batches):
            tables = distance_tables(cells, now)
            for part in _parts(batches):
                may = possible(_matrix(part.column("cells"), width, np.uint8), tables)
                cluster, distance = nearest(_matrix(part.column("x"), dims, np.int64), now, may)
                columns = [part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

        found = stored(vectors.select("vec_id", "cells", "x").mapInArrow(assign, schema), "clusters")
    finally:
        vectors.unpersist()
    inertia = np.zeros(len(now), np.int64)
    for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect():  # one row per cluster
        inertia[r["cluster"]] = r["s"]
    return Clustering(found, now, inertia)


def _oracle(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024) -> str:
    apart = "list_sum(list_transform(range(1, {d}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))".format(d=dims + 1)
    ctes = [
        f"""v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) = {dims}
      AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = {dims})""",
        f"""c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x
    FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h, x LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (
    SELECT vec_id, x, d[1] AS distance, d[2] AS j FROM (
      SELECT v.vec_id, v.x, min([CAST({apart} AS BIGINT), c.j]) AS d FROM v, c{r} c GROUP BY v.rowid_, v.vec_id, v.x))""")
        if r < rounds:
            ctes.append(f"""c{r + 1} AS MATERIALIZED (
    SELECT c.j, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN (
      SELECT j, list(m ORDER BY i) AS x FROM (
        SELECT j, i, (s - ((s % n) + n) % n) // n AS m FROM (
          SELECT j, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n
          FROM (SELECT j, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY j, i))
      GROUP BY j) n ON n.j = c.j)""")
    ctes[0] = ctes[0].replace("SELECT vec_id, list", "SELECT vec_id, row_number() OVER () AS rowid_, list")
    body = ",\n".join(ctes)
    return f"""WITH {body}
SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, a.distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"""


@query("op12_centroid_clustering", _oracle())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, m.tolist())).encode()).hexdigest() for m in found.centroids]
    rows = [(j, int(s), int(found.inertia.sum()), h) for j, (s, h) in enumerate(zip(found.inertia, digests))]
    schema = "cluster INT, cluster_inertia LONG, inertia LONG, centroid_sha256 STRING"
    # one row per centroid
    return found.vectors.join(F.broadcast(spark.createDataFrame(rows, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
