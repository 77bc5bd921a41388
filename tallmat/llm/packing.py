"""Best-fit packing by minimum bin slack.

Documents become token ids and an end id; documents longer than a sequence are cut into full pieces and a rest. Which
pieces share a sequence depends on their lengths alone, and there are at most `CAPACITY` lengths: their counts come to
the driver, never the pieces. Per sequence, a subset-sum over the lengths still available, held as the bits of one
integer, finds the fullest combination around the longest piece left. That combination is the best one again until one
of its lengths runs out, so it is taken as often as it can be; the number of distinct combinations does not grow with
the corpus. Pieces find their sequence by their rank among the pieces of equal length.

Defined cases: NULL and empty texts have the end id only; repeated rows are packed each by itself; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallmat.llm.common import query, stored, table, texts_of
from tallmat.llm.tokens import TOKEN_SLICE, Encoder, crc, tokenizer_path, with_end
from tallmat.llm.words import slices

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END = 1


def _piece_batches(batches: Iterator, path: str, spaces: bool, end: int, capacity: int, with_ids: bool) -> Iterator:
    encoder = Encoder(path, spaces)
    part = TaskContext.get().partitionId()
    used = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        for rows in slices(batch, limit=TOKEN_SLICE):
            ids, counts = with_end(*encoder.encode(rows.column("text")), end)
            pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, counts[doc] - start)
            at = (np.cumsum(counts) - counts)[doc] + start
            # rank among the pieces of equal length within this task
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))
            rank += used[length]
            used += np.bincount(length, minlength=capacity + 1)
            spans = list(zip(at.tolist(), (at + length).tolist()))
            columns = [
                pa.array(rows.column("doc_id").to_numpy()[doc]),
                pa.array(piece, pa.int32()),
                pa.array(start),
                pa.array(length),
                pa.array([crc(ids[a:b]) for a, b in spans], pa.int64()),
                pa.array(np.full(len(doc), part, np.int64)),
                pa.array(rank),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if with_ids:
                columns.append(pa.array([ids[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to `room`; long lengths are tried first.

    Bit s of `reach` tells whether the lengths seen so far can sum to s. Counts are taken in powers of two.
    """
    full = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((n for n in available if n <= room), reverse=True):
        left, take = min(available[length], room // length), 1
        while left:
            take = min(take, left)
            grown = (reach | reach << (length * take)) & full
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, and how many sequences each of them fills."""
    left = dict(counts)
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest({n: c for n, c in left.items() if c}, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // m for n, m in chosen.items())
        for n, m in chosen.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
        out.append((chosen, times))
    return out


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, pieces per sequence, first sequence, offset), by rank."""
    taken: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for chosen, times in patterns:
        offset = 0
        for length in sorted(chosen, reverse=True):
            first = taken.get(length, 0)
            rows.setdefault(length, []).append((first, chosen[length], sequence, offset))
            taken[length] = first + chosen[length] * times
            offset += length * chosen[length]
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def _place_batches(batches: Iterator, places) -> Iterator:
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
        sequence = np.zeros(len(length), np.int64)
        offset = np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            table_ = places.value[n]
            first, per, seq, off = table_[np.searchsorted(table_[:, 0], rank[rows], side="right") - 1].T
            sequence[rows] = seq + (rank[rows] - first) // per
            offset[rows] = off + (rank[rows] - first) % per * n
        keep = [c for c in batch.schema.names if c not in ("part", "rank", "base")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"]
        )


def pack(
    docs: DataFrame,
    path: str | None = None,
    spaces: bool = False,
    end: int = END,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece, and its ids if asked for."""
    spark = docs.sparkSession
    path = path or tokenizer_path(TOKENIZER)
    schema = "doc_id LONG, piece INT, start LONG, length LONG, ids_crc32 LONG, part LONG, rank LONG" + ", ids BINARY" * with_ids
    pieces = stored(
        texts_of(docs).mapInArrow(lambda b: _piece_batches(b, path, spaces, end, capacity, with_ids), schema), "pieces"
    )
    by_part = stored(pieces.groupBy("part", "length").agg((F.max("rank") + 1).alias("n")), "lengths")
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    names = ["doc_id LONG", "piece INT", "start LONG", "length LONG", "ids_crc32 LONG", *["ids BINARY"] * with_ids]
    ordered = [n.split()[0] for n in names]
    return (
        pieces.join(bases, ["part", "length"])
        .select(*ordered, "part", "rank", "base")
        .mapInArrow(lambda b: _place_batches(b, places), ", ".join([*names, "sequence_id LONG", "offset LONG"]))
    )


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
