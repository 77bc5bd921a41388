"""Benchmark decontamination: find copies of test items in documents, edited ones included.

Seeds are 3-word runs of the items, all that occur in any document. Their occurrences are counted first: within a
document an item is aligned with the words around its rarest seeds first, by Smith-Waterman, and with those around the
others only where the item's words present there can still reach the limit and the best score so far; no alignment is
lost by that. The score is relative to that of a whole exact copy.

The items are the query set: they come in blocks of bounded size, each broadcast in turn, and every document meets
every block. Documents are never shuffled.

Defined cases: letters are compared without case; NULL or empty texts match nothing; items of fewer than three
words identify nothing and match nothing; items without an id are left out; among rows with the same ids the best
alignment counts, ties going to the first place; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.llm.common import Sent, query, table, texts_of
from tallmat.llm.words import Words, ranges, slices, window_starts, windows

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
# Words of items broadcast at once (8 bytes of word hash and about 16 of seed each).
BLOCK_WORDS = 500_000
_FILTER_BITS = 20


class Seeds:
    """A sorted set of run hashes with a bit filter in front."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into x that hold a known run, and the place of that run in the set."""
        likely = np.flatnonzero(self.filter[(x >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.grams, x[likely]), len(self.grams) - 1)
        same = self.grams[place] == x[likely]
        return likely[same], place[same]


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Score of the best local alignment, and the text words it spans (start, end); the first end among equals.

    Rows of the table follow the item; gaps along a row are a running maximum. The start is carried with the score.
    """
    n = len(text)
    step = np.arange(n + 1) * -GAP
    score = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = score[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = score[1:] + GAP
        fresh = np.zeros(n + 1, np.int64)
        origin = np.arange(n + 1)
        fresh[1:] = np.maximum(diagonal, up)
        origin[1:] = np.where(diagonal >= up, begin[:-1], begin[1:])
        empty = fresh <= 0
        fresh[empty] = 0
        origin[empty] = np.flatnonzero(empty)
        lifted = fresh + step
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(n + 1), 0))
        score = reach - step
        begin = np.where(score > 0, origin[source], np.arange(n + 1))
        score = np.maximum(score, 0)
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(begin[top]), top)
    return best


def _count_batches(batches: Iterator, seeds) -> Iterator:
    """How often each known run occurs in these documents; one row per run and task."""
    total = np.zeros(len(seeds.value.grams), np.int64)
    for batch in batches:
        for piece in slices(batch):
            words = Words(piece.column("text"))
            starts = window_starts(words.first, SEED_WORDS)
            if len(starts):
                _, place = seeds.value.find(windows(words.hashes(), SEED_WORDS)[starts])
                total += np.bincount(place, minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["place", "n"])


def _stretches(starts: np.ndarray, counts: np.ndarray, length: int, limit: int) -> list[tuple[int, int, int]]:
    """Stretches of text that hold every alignment begun at these diagonals, overlapping ones joined: the least count
    of their seeds, begin and end; rarest first."""
    pad = length // 2 + 2
    out: list[tuple[int, int, int]] = []
    order = np.argsort(starts, kind="stable")
    for s, n in zip(starts[order].tolist(), counts[order].tolist()):
        a, b = max(0, s - pad), min(limit, s + length + pad)
        if out and a <= out[-1][2]:
            out[-1] = (min(n, out[-1][0]), out[-1][1], b)
        else:
            out.append((n, a, b))
    return sorted(out)


def _best_alignment(item: np.ndarray, own: np.ndarray, stretches: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Score, start and end of the best alignment in any stretch, the first one among equals; zeros below the limit."""
    best = (0, 0, 0)
    for _, a, b in stretches:
        # each word of the item matches once at most
        bound = MATCH * int(np.isin(item, own[a:b]).sum())
        if bound < MIN_SCORE * MATCH * len(item) or bound < best[0]:
            continue
        score, begin, end = smith_waterman(item, own[a:b])
        if score > best[0] or score == best[0] and a + begin < best[1]:
            best = (score, a + begin, a + end)
    return best


def _align_batches(batches: Iterator, block) -> Iterator:
    seeds, counts, owner_first, owner_item, runs, items = block.value
    for batch in batches:
        for piece in slices(batch):
            words = Words(piece.column("text"))
            starts = window_starts(words.first, SEED_WORDS)
            if not len(starts):
                continue
            x = words.hashes()
            hit, place = seeds.find(windows(x, SEED_WORDS)[starts])
            hit = starts[hit]
            text = np.searchsorted(words.first, hit, side="right") - 1
            ids = piece.column("doc_id").to_pylist()
            rows = []
            cuts = np.flatnonzero(np.diff(text)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)]):
                if lo == hi:
                    continue
                t = int(text[lo])
                own = x[words.first[t] : words.first[t + 1]]
                order = lo + np.argsort(place[lo:hi], kind="stable")
                at, seed = hit[order] - words.first[t], place[order]
                known, first = np.unique(seed, return_index=True)
                first = np.append(first, len(seed))
                many = owner_first[known + 1] - owner_first[known]
                near = np.unique(owner_item[np.repeat(owner_first[known], many) + ranges(many)])
                vocabulary = np.unique(own)
                for i in near.tolist():
                    item_id, item = items[i]
                    found = np.minimum(np.searchsorted(vocabulary, item), len(vocabulary) - 1)
                    if (vocabulary[found] == item).sum() < MIN_SCORE * len(item):
                        continue
                    which = np.minimum(np.searchsorted(known, runs[i]), len(known) - 1)
                    offset = np.flatnonzero(known[which] == runs[i])
                    which = which[offset]
                    n = first[which + 1] - first[which]
                    diagonals = at[np.repeat(first[which], n) + ranges(n)] - np.repeat(offset, n)
                    stretches = _stretches(diagonals, np.repeat(counts[known[which]], n), len(item), len(own))
                    best = _best_alignment(item, own, stretches)
                    share = best[0] / (MATCH * len(item))
                    if share >= MIN_SCORE:
                        rows.append((ids[t], item_id, share, best[1], best[2]))
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "score", "start", "end"]
                )


def _item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as (id, word hashes), a bounded number of words at a time."""
    text = F.lower(F.col("text").cast("string")).alias("text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text)
    block, size = [], 0
    for r in items.where("item_id IS NOT NULL").dropDuplicates().toLocalIterator():
        item = Words(pa.array([r.text], pa.string())).hashes()
        if len(item) < SEED_WORDS:
            continue
        block.append((r.item_id, item))
        size += len(item)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, start, end): the best alignment of each item with each document that holds a copy."""
    spark = docs.sparkSession
    texts = texts_of(docs).withColumn("text", F.lower("text"))
    found = spark.createDataFrame([], "doc_id LONG, item_id LONG, score DOUBLE, start INT, end INT")
    for items in _item_blocks(benchmark, block_words):
        runs = [windows(item, SEED_WORDS) for _, item in items]
        grams, place = np.unique(np.concatenate(runs), return_inverse=True)
        known = Sent(spark, Seeds(grams))
        counted = texts.mapInArrow(lambda b, known=known: _count_batches(b, known), "place LONG, n LONG")
        total = np.zeros(len(grams), np.int64)
        for r in counted.groupBy("place").agg(F.sum("n").alias("n")).toLocalIterator():
            total[r.place] = r.n
        kept = np.flatnonzero(total)
        if not len(kept):
            continue
        item_of = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        number = np.full(len(grams), -1)
        number[kept] = np.arange(len(kept))
        owner = number[place]
        order = np.argsort(owner, kind="stable")[(owner < 0).sum() :]
        first = np.searchsorted(owner[order], np.arange(len(kept) + 1))
        by_item = np.split(owner, np.cumsum([len(r) for r in runs])[:-1])
        block = Sent(spark, (Seeds(grams[kept]), total[kept], first, item_of[order], by_item, items))
        aligned = texts.mapInArrow(
            lambda b, block=block: _align_batches(b, block), "doc_id LONG, item_id LONG, score DOUBLE, start INT, end INT"
        )
        found = found.unionByName(aligned)
    best = F.max(F.struct("score", (-F.col("start")).alias("before"), "end"))
    return (
        found.groupBy("doc_id", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "item_id", "best.score", (-F.col("best.before")).alias("start"), "best.end")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no copy of a test item, with all their columns."""
    leaks = contaminated(docs, benchmark).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(leaks, docs["doc_id"].cast("long") == F.col("_id"), "left_anti")


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item that it holds, copied or edited."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
