"""Labelled rows and logistic regression, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.llm.common import crc32_remainder, cut_lineage


BINS = 4096


def training_labels(labels: DataFrame, label: str, divisor: int, held_out: int) -> DataFrame:
    """(doc_id, y) of all ids that are not held out.

    A NULL label counts as none; of contradicting labels of one document the larger counts.
    """
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id IS NOT NULL AND y IS NOT NULL")
        .where(crc32_remainder(divisor) != held_out)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held_out: int, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most `limit` labelled documents that are not held out.

    The documents are those with the smallest hash of their id. The ids are few by `limit`, so they are broadcast and no
    text is shuffled.
    """
    chosen = training_labels(labels, label, divisor, held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(cut_lineage(chosen)), "doc_id")


def order_statistic(rows: DataFrame, column: str, rank: int) -> float:
    """The value with `rank` smaller or equal ones before it: bins between the extremes, then bins within the bin."""
    value = F.col(column)
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        share = (value - F.lit(low)) / F.lit(high - low)
        place = F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("place")
        within = rows.where(value.between(low, high)).groupBy(place)
        for r in sorted(within.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()):
            if rank < r.n:
                break
            rank -= r.n
        low, high = r.low, r.high
    return low


def standardized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the columns; constant columns get deviation 1."""
    if not len(x):
        return np.zeros(x.shape[1]), np.ones(x.shape[1])
    deviation = x.std(0)
    return x.mean(0), np.where(deviation > 1e-12, deviation, 1.0)


def newton(sums: Callable, width: int, penalty: float, steps: int = 30) -> np.ndarray:
    """Newton steps from 0 until they settle; `sums` gives gradient and curvature of the loss, without the ridge penalty."""
    w = np.zeros(width)
    for _ in range(steps):
        gradient, curvature = sums(w)
        step = np.linalg.solve(curvature + penalty * np.eye(width), gradient + penalty * w)
        w -= step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return w


def logistic_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a ridge-penalized logistic regression without intercept."""
    return newton(lambda w: logistic_sums(x, y, w), x.shape[1], penalty)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
