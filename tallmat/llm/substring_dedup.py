"""Substring dedup: remove the later copies of every repeated run of 50 words.

Rabin-Karp hashes of every window of 50 consecutive words are counted in Spark; windows whose words also start in a
document with a smaller id are merged into maximal removal intervals.

What repeats in whole is settled first: a document with the words of one with a smaller id loses every word, and its
windows, which could only repeat those of the smaller one, take no further part. Then, two equal windows contain equal
sub-windows, so both pick the same `seed`, the smallest hash among their 10-word sub-windows. Neighbouring windows
mostly share it. A first count is therefore over seeds (about one per twenty words); only windows whose seed occurs in
two documents can repeat, and only these go on to the count of whole windows. This loses nothing and keeps the shuffle
small. Hashes have 64 bits, and removal is decided by (window hash, doc_id) alone.

Defined cases: a NULL or empty text has no words; a text of fewer than 50 words has no window; rows with equal doc_id
are never removed on account of each other, and each is judged by its own text; empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.llm.common import cut_lineage, query, stored, table, texts_of
from tallmat.llm.words import WORD_BASE, Words, as_long, lists, mix, powers, ranges, slices, window_starts, windows

WINDOW = 50
SEED_WORDS = 10


def _window_seeds(x: np.ndarray, window: int, part: int) -> np.ndarray:
    """For every window the smallest hash of its sub-windows."""
    least = windows(x, part)
    span, width = 1, window - part + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least


def _whole(words: Words, x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have a window, and a hash of all the words of each."""
    long_enough = np.flatnonzero(words.counts >= window)
    up, _ = powers(WORD_BASE, int(words.counts.max(initial=1)))
    terms = x * up[ranges(words.counts)]
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return long_enough, mix(sums[words.first[1:]] - sums[words.first[:-1]])[long_enough]


def _seed_batches(batches: Iterator, window: int, part: int) -> Iterator:
    """(seed, doc_id, whole) rows; one row per text has no seed."""
    for batch in batches:
        for piece in slices(batch):
            words = Words(piece.column("text"))
            starts = window_starts(words.first, window)
            if not len(starts):
                continue
            x = words.hashes()
            seeds = _window_seeds(x, window, part)[starts]
            text = words.text_of_word()[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (seeds[1:] != seeds[:-1]) | (text[1:] != text[:-1])
            long_enough, whole = _whole(words, x, window)
            ids = piece.column("doc_id").to_numpy()
            rank = np.searchsorted(long_enough, text[new])
            for seed, doc, key in (
                (pa.array(as_long(seeds[new])), ids[text[new]], whole[rank]),
                (pa.nulls(len(whole), pa.int64()), ids[long_enough], whole),
            ):
                yield pa.RecordBatch.from_arrays([seed, pa.array(doc), pa.array(as_long(key))], names=["seed", "doc_id", "whole"])


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _window_batches(batches: Iterator, window: int, part: int) -> Iterator:
    """Finished rows for copies and for texts without a repeated seed; text and suspected windows of the others."""
    for batch in batches:
        for piece in slices(batch):
            words = Words(piece.column("text"))
            n = piece.num_rows
            raw = piece.column("text").fill_null("").to_pylist()
            counts = words.counts
            copied = np.zeros(n, bool)
            suspected = [np.zeros(0, np.int64)] * n
            marked = piece.column("seeds").is_valid().to_numpy(zero_copy_only=False)
            if marked.any():
                x = words.hashes()
                long_enough, whole = _whole(words, x, window)
                whole_of = dict(zip(long_enough.tolist(), as_long(whole).tolist()))
                seeds = _window_seeds(x, window, part)
                hashes = as_long(windows(x, window))
                for i in np.flatnonzero(marked & (counts >= window)):
                    copied[i] = whole_of[i] in piece.column("wholes")[i].as_py()
                    if not copied[i]:
                        span = slice(words.first[i], words.first[i + 1] - window + 1)
                        known = piece.column("seeds")[i].values.to_numpy().view(np.uint64)
                        suspected[i] = np.unique(hashes[span][np.isin(seeds[span], known)])
            lengths = np.array([len(h) for h in suspected], np.int64)
            open_rows = lengths > 0
            sha = [None if o else _digest([] if c else t.encode().split()) for t, o, c in zip(raw, open_rows, copied)]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(counts.astype(np.int64)),
                    pa.array(np.where(copied, counts, 0).astype(np.int64)),
                    pa.array(sha, pa.string()),
                    pa.array([t if o else None for t, o in zip(raw, open_rows)], pa.string()),
                    lists(np.concatenate(suspected) if n else np.zeros(0, np.int64), lengths, pa.int64()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "text", "hashes"],
            )


def _cut_batches(batches: Iterator, window: int) -> Iterator:
    """Merge repeated windows into maximal intervals and drop the words inside."""
    for batch in batches:
        for piece in slices(batch):
            words = Words(piece.column("text"))
            hashes = as_long(windows(words.hashes(), window))
            rows = []
            for i, text in enumerate(piece.column("text").to_pylist()):
                own = text.encode().split()
                gone = np.zeros(len(own) + 1, np.int64)
                repeated = piece.column("repeated")[i]
                if repeated.is_valid:
                    own_hashes = hashes[words.first[i] : words.first[i + 1] - window + 1]
                    places = np.flatnonzero(np.isin(own_hashes, repeated.values.to_numpy()))
                    gone[places] += 1
                    gone[places + window] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                kept = [w for w, g in zip(own, gone) if not g]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                kept_text = b" ".join(kept).decode() if gone.any() else None
                rows.append((len(own), int(gone.sum()), _digest(kept), kept_text, edges.tolist()))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "edges"],
            )


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, edges) of every row of (doc_id, text).

    `edges` lists the removed intervals as word places: start, end, start, end and so on. `kept_text` has the kept
    words joined by one space; it is NULL where nothing was removed (the text stands as it is).
    """
    texts = texts_of(docs)
    part = min(seed_words, window)
    found = stored(texts.mapInArrow(lambda b: _seed_batches(b, window, part), "seed LONG, doc_id LONG, whole LONG"), "seeds")

    wholes = found.where("seed IS NULL").select("doc_id", "whole")
    firsts = cut_lineage(
        wholes.groupBy("whole").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    )
    copies = cut_lineage(wholes.join(firsts, "whole").where("doc_id > low").select("doc_id", "whole").distinct())
    seeds = found.where("seed IS NOT NULL").join(copies, ["doc_id", "whole"], "left_anti").select("doc_id", "seed")
    shared = cut_lineage(
        seeds.groupBy("seed")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high")
        .select("seed")
    )
    suspects = (
        seeds.join(shared, "seed", "left_semi")
        .withColumn("whole", F.lit(None).cast("long"))
        .unionByName(copies.withColumn("seed", F.lit(None).cast("long")))
        .groupBy("doc_id")
        .agg(F.collect_set("seed").alias("seeds"), F.collect_set("whole").alias("wholes"))
    )
    marked = stored(
        texts.join(suspects, "doc_id", "left").mapInArrow(
            lambda b: _window_batches(b, window, part),
            "doc_id LONG, n_words LONG, n_removed LONG, kept_sha256 STRING, text STRING, hashes ARRAY<LONG>",
        ),
        "windows",
    )
    open_rows = marked.where("text IS NOT NULL")
    placed = open_rows.select("doc_id", F.explode("hashes").alias("hash"))
    repeated = cut_lineage(
        placed.groupBy("hash")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high")
        .select("hash", "low")
    )
    removed = (
        placed.join(repeated, "hash").where("doc_id > low").groupBy("doc_id").agg(F.collect_set("hash").alias("repeated"))
    )
    cut = (
        open_rows.select("doc_id", "text")
        .join(removed, "doc_id", "left")
        .mapInArrow(
            lambda b: _cut_batches(b, window),
            "doc_id LONG, n_words LONG, n_removed LONG, kept_sha256 STRING, kept_text STRING, edges ARRAY<INT>",
        )
    )
    whole = marked.where("text IS NULL").select(
        "doc_id",
        "n_words",
        "n_removed",
        "kept_sha256",
        F.expr("CASE WHEN n_removed > 0 THEN '' END").alias("kept_text"),
        F.expr("CASE WHEN n_removed > 0 THEN array(0, CAST(n_words AS INT)) ELSE CAST(array() AS ARRAY<INT>) END").alias("edges"),
    )
    return whole.unionByName(cut)


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
