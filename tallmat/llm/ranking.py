"""Quality classifier by Bradley-Terry ranking.

Labelled documents give preference pairs (a good one over a bad one). The score of a document is linear in its
features, and the weights minimize the logistic loss on the feature differences of the pairs. The threshold is a
quantile: the share of bad documents among all labelled ones, taken of their scores. Reported scores are shifted so that
the threshold is at 0.3.

All labelled rows count, in the model as in its threshold. The features of all documents are stored once. Both classes are
dealt evenly, in the order of a hash, over groups of about `GROUP` rows; where the fewer class has less rows than there are
groups, each of its rows is in several. A group pairs each of its fewer class with `PAIRS` of the other, and with more of
them until every row is in a pair. Each Newton step sums gradient and curvature over the groups.

Features describe the words, characters and repetition of the whole text; no other column is read.

Defined cases: a NULL or empty text has features of its own (no words) and is scored like any other; without both
classes of labels every score is 0.5; repeated rows are scored alike; empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallmat.llm.common import Sent, crc32_remainder, query, stored, table, texts_of
from tallmat.llm.learning import logistic, logistic_sums, newton, order_statistic, sigmoid, standardized, training_labels
from tallmat.llm.near_dedup import _groups
from tallmat.llm.words import Words, slices, window_starts, windows

GROUP = 256
PAIRS = 20
PENALTY = 5.0
# Ids of one class that are numbered in one window.
NUMBERED = 10_000
THRESHOLD = 0.3
RUN = 5


def _class(characters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters)] = True
    return found


# character classes counted by byte; a text of a few hundred words has a few thousand bytes
_CLASSES = [
    _class(bytes(range(65, 91))),
    _class(bytes(range(97, 123))),
    _class(b"0123456789"),
    _class(b".,;:?'()-"),
    _class(b"!"),
    _class(b"#*$%&<>"),
    _class(b"|"),
    _class(b"@/\\=_+~^{}[]`\""),
    _class(bytes(range(0xC2, 0xF5))),
]


def _distinct(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Distinct values per text."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """One row per text."""
    words = Words(texts)
    n = len(words.first) - 1
    counts = words.counts
    size = np.maximum(np.diff(words.offsets), 1)
    sums = np.zeros(len(words.data) + 1, np.int64)
    columns = [np.log1p(counts), counts == 0, np.maximum(0, 10 - counts)]
    for members in _CLASSES:
        np.cumsum(members[words.data], out=sums[1:])
        share = (sums[words.offsets[1:]] - sums[words.offsets[:-1]]) / size
        columns += [share, np.sqrt(share)]
    text = words.text_of_word()
    length = words.end - words.start
    some = np.maximum(counts, 1)
    mean = np.bincount(text, length, n) / some
    columns += [np.log1p(mean), np.sqrt(np.maximum(0, np.bincount(text, length.astype(float) ** 2, n) / some - mean**2))]
    for limit in (2, 3, 4):
        columns.append(np.bincount(text, length <= limit, n) / some)
    x = words.hashes()
    columns.append(_distinct(x, text, n) / some)
    starts = window_starts(words.first, RUN)
    runs = np.maximum(np.bincount(text[starts], minlength=n), 1)
    repeated = 1 - _distinct(windows(x, RUN)[starts], text[starts], n) / runs if len(starts) else np.zeros(n)
    repeated[counts < RUN] = 0
    columns += [repeated, np.sqrt(np.maximum(repeated, 0))]
    same = np.zeros(len(x), bool)
    same[1:] = (x[1:] == x[:-1]) & (text[1:] == text[:-1])
    columns.append(np.bincount(text, same, n) / some)
    np.cumsum(words.data == 0x0A, out=sums[1:])
    columns.append(np.log1p((sums[words.offsets[1:]] - sums[words.offsets[:-1]]) / some * 100))
    return np.column_stack(columns).astype(float)


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    cut: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.deviation @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.rank(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)))


def _differences(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS) -> np.ndarray:
    """Good less bad: each of the fewer class with `pairs` of the other, and as many as put every row into a pair."""
    few, many = sorted((len(good), len(bad)))
    p = np.arange(max(pairs * few, many))
    # both classes in turn, moved on by one where the pairs would repeat
    left, right = p % few, (p + p // np.lcm(few, many)) % many
    return good[right] - bad[left] if len(bad) <= len(good) else good[left] - bad[right]


def _without_classes(mean: np.ndarray, deviation: np.ndarray) -> Model:
    return Model(mean, deviation, np.zeros(len(mean)), float(np.log(THRESHOLD / (1 - THRESHOLD))))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> Model:
    """The model of rows in memory, as one group."""
    mean, deviation = standardized(x)
    z = (x - mean) / deviation
    good, bad = z[y == 1], z[y == 0]
    if not len(good) or not len(bad):
        return _without_classes(mean, deviation)
    difference = _differences(good, bad, pairs)
    weights = logistic(difference, np.ones(len(difference)), PENALTY)
    scores = np.sort(z @ weights)
    # halfway between the documents on both sides of the quantile
    rank = len(bad)
    cut = (scores[rank - 1] + scores[min(rank, len(scores) - 1)]) / 2
    return Model(mean, deviation, weights, float(cut))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles that are stored as bytes."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _feature_batches(batches: Iterator, names: list[str]) -> Iterator:
    for batch in batches:
        for piece in slices(batch):
            x = pa.array([row.tobytes() for row in features(piece.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in names], x], names=[*names, "x"])


def _moment_batches(batches: Iterator) -> Iterator:
    """Rows, means and squared deviations of every batch."""
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            mean = x.mean(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x)]), pa.array([mean.tobytes()]), pa.array([((x - mean) ** 2).sum(0).tobytes()])], names=["n", "mean", "squares"]
            )


def _group_batches(batches: Iterator, mean: np.ndarray, deviation: np.ndarray) -> Iterator:
    """One record per group: the standardized rows of both classes."""
    for group in _groups(batches, "dealt"):
        z = (_matrix(group.column("x")) - mean) / deviation
        y = group.column("y").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([z[y == k].tobytes()], pa.binary()) for k in (1, 0)], names=["good", "bad"])


def _sum_batches(batches: Iterator, w: np.ndarray) -> Iterator:
    """Gradient and curvature over the groups of a task."""
    gradient, curvature = np.zeros(len(w)), np.zeros((len(w), len(w)))
    for batch in batches:
        for good, bad in zip(batch.column("good").to_pylist(), batch.column("bad").to_pylist()):
            x = _differences(*[np.frombuffer(v, np.float64).reshape(-1, len(w)) for v in (good, bad)])
            g, c = logistic_sums(x, np.ones(len(x)), w)
            gradient += g
            curvature += c
    yield pa.RecordBatch.from_arrays([pa.array([gradient.tobytes()]), pa.array([curvature.tobytes()])], names=["gradient", "curvature"])


def _score_batches(batches: Iterator, model) -> Iterator:
    for batch in batches:
        if batch.num_rows:
            score = model.value.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def _rank_batches(batches: Iterator, model) -> Iterator:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(model.value.rank(_matrix(batch.column("x"))))], names=["z"])


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, ..., x): the features of every row as bytes."""
    names = ["doc_id", *more]
    wanted = texts_of(docs, *more)
    schema = ", ".join([f"{n} {wanted.schema[n].dataType.simpleString()}" for n in names] + ["x BINARY"])
    return wanted.mapInArrow(lambda b: _feature_batches(b, names), schema)


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """As `standardized`, with the moments of the batches merged one by one."""
    n, mean, squares = 0, None, None
    for r in rows.select("x").mapInArrow(_moment_batches, "n LONG, mean BINARY, squares BINARY").toLocalIterator():
        m, s = np.frombuffer(bytes(r.mean)), np.frombuffer(bytes(r.squares))
        if not n:
            n, mean, squares = r.n, m, s
            continue
        apart = m - mean
        squares = squares + s + apart**2 * (n * r.n / (n + r.n))
        mean, n = mean + apart * (r.n / (n + r.n)), n + r.n
    if not n:
        return standardized(features(pa.array([""]))[:0])
    deviation = np.sqrt(squares / n)
    return mean, np.where(deviation > 1e-12, deviation, 1.0)


def _numbered(ids: DataFrame) -> DataFrame:
    """(doc_id, y, number): the ids of each class in the order of a hash, from 0."""
    parts = ids.count() // NUMBERED + 1
    placed = ids.withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod("h", F.lit(parts)))
    before = Window.partitionBy("y").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("y", "part").count().select("y", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("y", "part").orderBy("h", "doc_id")) - 1
    return placed.withColumn("inside", inside).join(first, ["y", "part"]).select("doc_id", "y", (F.col("first") + F.col("inside")).alias("number"))


def _dealt(rows: DataFrame, mean: np.ndarray, deviation: np.ndarray) -> DataFrame | None:
    """(good, bad) of every group, or nothing where a class has no row."""
    numbered = stored(_numbered(rows.where("y IN (0, 1)").select("doc_id", "y").distinct()), "ranking-numbers")
    counts = {r.y: r["count"] for r in numbered.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    groups = -(-sum(counts.values()) // GROUP)
    fewer = 0 if counts[0] <= counts[1] else 1
    # rows of a class with less rows than groups go to several groups
    step = F.when(F.col("y") == fewer, min(counts[fewer], groups)).otherwise(groups).cast("bigint")
    dealt = F.explode(F.sequence(F.pmod("number", F.lit(groups)), F.lit(groups - 1).cast("bigint"), step)).alias("dealt")
    wide = rows.join(numbered.select("doc_id", "number", dealt), "doc_id").where("y IN (0, 1)")
    return (
        wide.repartition("dealt")
        .sortWithinPartitions("dealt", "number", "x")
        .select("dealt", "y", "x")
        .mapInArrow(lambda b: _group_batches(b, mean, deviation), "good BINARY, bad BINARY")
    )


def learn_measured(rows: DataFrame) -> Model:
    """A model from a table (doc_id, y, x) of any size."""
    rows = stored(rows.select("doc_id", "y", "x"), "ranking-rows")
    mean, deviation = _moments(rows)
    dealt = _dealt(rows, mean, deviation)
    if dealt is None:
        return _without_classes(mean, deviation)
    dealt = stored(dealt, "ranking-groups")
    width = len(mean)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gradient, curvature = np.zeros(width), np.zeros((width, width))
        for r in dealt.mapInArrow(lambda b: _sum_batches(b, w), "gradient BINARY, curvature BINARY").collect():
            gradient += np.frombuffer(bytes(r.gradient))
            curvature += np.frombuffer(bytes(r.curvature)).reshape(width, width)
        return gradient, curvature

    model = Model(mean, deviation, newton(sums, width, PENALTY), 0.0)
    shared = Sent(rows.sparkSession, model)
    ranks = stored(rows.select("x").mapInArrow(lambda b: _rank_batches(b, shared), "z DOUBLE"), "ranking-scores")
    # halfway between the documents on both sides of the quantile
    bad, n = rows.where("y = 0").count(), rows.count()
    model.cut = (order_statistic(ranks, "z", bad - 1) + order_statistic(ranks, "z", min(bad, n - 1))) / 2
    return model


def learn(labelled: DataFrame) -> Model:
    """A model from a table (doc_id, text, y)."""
    return learn_measured(measured(labelled, "y"))


def score_measured(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of features."""
    shared = Sent(rows.sparkSession, model)
    return rows.mapInArrow(lambda b: _score_batches(b, shared), "doc_id LONG, score DOUBLE")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    return score_measured(measured(docs), model)


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(measured(table(spark, sf_dir, "documents")), "ranking-features")
    model = learn_measured(rows.join(training_labels(table(spark, sf_dir, "labels"), "quality", 5, 0), "doc_id"))
    return score_measured(rows, model).select(
        "doc_id",
        (crc32_remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
