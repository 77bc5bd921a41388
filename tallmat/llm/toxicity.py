"""Toxicity: misspelled lexicon terms by Levenshtein automata, weighed by their context.

The lexicon is learned from labelled documents: word beginnings (and whole words) that occur far more often in toxic
ones. Its terms form a trie; the trie and the automaton that accepts everything within some edits are intersected into
one table of transitions, and all distinct words of a batch run through the table together. Short terms must match
exactly, those of five letters or more may differ by one edit, of nine or more by two.

A document is scored on its hits: exact and misspelled, inside and outside quotation marks, how many different ones,
how dense they are and how close they stand together in windows of 20 words. A logistic regression on labelled
documents weighs these. Lexicon and weights are learned from at most `MAX_TRAIN` labelled rows.

Defined cases: letters are compared without case; a NULL or empty text has no hits and gets the score of a document
without hits; without any labels (or with one class only) every score is that of the prior; repeated rows are scored
alike; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.llm.common import Sent, crc32_remainder, query, table, texts_of
from tallmat.llm.learning import labelled_sample, logistic, sigmoid, standardized
from tallmat.llm.words import LETTER_BYTE, Words, slices

MAX_TRAIN = 12_000
THRESHOLD = 0.7
MIN_STEM, MAX_STEM = 4, 14
# A term occurs in this many toxic documents of the sample at least, and is this much likelier there (log of ratio).
MIN_SUPPORT = 5
MIN_LOG_RATIO = 3.0
MAX_TERMS = 120
SPAN = 20
LONGEST = 24
FEATURES = 8


def edits_allowed(letters: int) -> int:
    return 0 if letters < 5 else 1 if letters < 9 else 2


@dataclass
class Automaton:
    """Transitions of trie x Levenshtein automaton: next state by state and letter; edits of a word ending in a state."""

    letters: np.ndarray
    move: np.ndarray
    edits: np.ndarray
    term: np.ndarray

    def run(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits (9: no match) and the matched term of every word."""
        grid = np.array([w[:LONGEST] for w in words], dtype=f"U{LONGEST}").view(np.uint32).reshape(len(words), LONGEST)
        place = np.minimum(np.searchsorted(self.letters, grid), len(self.letters) - 1)
        letter = np.where(self.letters[place] == grid, place, len(self.letters))
        state = np.zeros(len(words), np.int64)
        for j in range(LONGEST):
            there = grid[:, j] != 0
            if not there.any():
                break
            state = np.where(there, self.move[state, letter[:, j]], state)
        return self.edits[state], self.term[state]


def build_automaton(terms: list[tuple[str, bool]], edits: int) -> Automaton:
    """Terms are (text, whole): a whole term matches a word, any other one the beginning of a word."""
    children: list[dict[str, int]] = [{}]
    ends: list[tuple[int, bool] | None] = [None]
    for number, (text, whole) in enumerate(terms):
        node = 0
        for c in text:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(None)
            node = children[node][c]
        ends[node] = (number, whole)
    letters = sorted({c for text, _ in terms for c in text})

    def close(states: dict[int, int], found: tuple[int, int] | None):
        """Adds what missing letters reach; `found` is the best (edits, term) of a beginning already matched."""
        queue = list(states.items())
        while queue:
            node, e = queue.pop()
            if e < edits:
                for child in children[node].values():
                    if states.get(child, 9) > e + 1:
                        states[child] = e + 1
                        queue.append((child, e + 1))
        for node, e in states.items():
            end = ends[node]
            if end and not end[1] and (found is None or (e, end[0]) < found):
                found = (e, end[0])
        return frozenset(states.items()), found

    start = close({0: 0}, None)
    number = {start: 0}
    order = [start]
    move = []
    for states, found in order:
        row = []
        for c in [*letters, ""]:
            reached: dict[int, int] = {}

            def put(node: int, e: int) -> None:
                if e <= edits and reached.get(node, 9) > e:
                    reached[node] = e

            for node, e in states:
                put(node, e + 1)
                for letter, child in children[node].items():
                    put(child, e + (letter != c))
            target = close(reached, found)
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        move.append(row)
    best = []
    for states, found in order:
        options = [(e, ends[n][0]) for n, e in states if ends[n] and ends[n][1]]
        best.append(min(options + ([found] if found else []), default=(9, -1)))
    return Automaton(
        np.array([ord(c) for c in letters], np.uint32) if letters else np.zeros(1, np.uint32),
        np.array(move, np.int32) if letters else np.zeros((1, 2), np.int32),
        np.array([b[0] for b in best], np.int64),
        np.array([b[1] for b in best], np.int64),
    )


class Lexicon:
    """Terms with the automata of each number of edits."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.parts = []
        for k in (0, 1, 2):
            rows = [i for i, (text, _) in enumerate(terms) if edits_allowed(len(text)) == k]
            if rows:
                self.parts.append((build_automaton([terms[i] for i in rows], k), np.array(rows)))

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        edits = np.full(len(words), 9, np.int64)
        term = np.full(len(words), -1, np.int64)
        for automaton, rows in self.parts:
            e, t = automaton.run(words)
            better = e < edits
            edits[better], term[better] = e[better], rows[t[better]]
        return edits, term


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of hit statistics per (lower-case) text."""
    words = Words(texts, inside=LETTER_BYTE)
    n = len(words.first) - 1
    out = np.zeros((n, FEATURES))
    if not len(words):
        return out
    offsets = np.empty(2 * len(words), np.int64)
    # letters between words belong to no word: cut the bytes into word, rest, word, rest ...
    offsets[0::2], offsets[1::2] = words.start, words.end
    shifted = np.append(offsets, len(words.data))
    pieces = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(shifted) - 1, [None, pa.py_buffer(shifted), pa.py_buffer(np.ascontiguousarray(words.data))]
    ).take(pa.array(np.arange(0, len(offsets), 2)))
    coded = pieces.dictionary_encode()
    code = coded.indices.to_numpy()
    edits, term = lexicon.match([w.decode("utf-8", "replace") for w in coded.dictionary.to_pylist()])
    hit = np.flatnonzero(edits[code] < 9)
    if not len(hit):
        return out
    text = np.searchsorted(words.first, hit, side="right") - 1
    quotes = np.concatenate([[0], np.cumsum(words.data == 0x22)])
    quoted = (quotes[words.start[hit]] - quotes[words.offsets[text]]) % 2 == 1
    exact = edits[code[hit]] == 0
    for column, rows in enumerate((exact & ~quoted, exact & quoted, ~exact & ~quoted, ~exact & quoted)):
        out[:, column] = np.log1p(np.bincount(text[rows], minlength=n))
    total = np.bincount(text, minlength=n)
    out[:, 4] = np.log1p(100 * total / np.maximum(words.counts, 1))
    out[:, 5] = np.log1p(np.bincount(np.unique(np.stack([text, term[code[hit]]]), axis=1)[0], minlength=n))
    # most hits in any window of SPAN words of one text
    last = np.searchsorted(hit, np.minimum(hit + SPAN, words.first[text + 1]))
    np.maximum.at(out[:, 6], text, np.log1p(last - np.arange(len(hit))))
    out[:, 7] = total > 0
    return out


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool]]:
    """Beginnings and whole words that mark toxic documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    long_words = F.filter(words, lambda w: F.length(w) >= MIN_STEM)

    def beginnings(w):
        # "$" marks the end of a word
        return F.transform(F.sequence(F.lit(MIN_STEM), F.least(F.length(w) + 1, F.lit(MAX_STEM))), lambda k: F.substring(F.concat(w, F.lit("$")), F.lit(1), k))

    counted = (
        sample.select("y", F.explode(F.array_distinct(F.flatten(F.transform(long_words, beginnings)))).alias("stem"))
        .groupBy("stem")
        .agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
        .where(F.col("toxic") >= MIN_SUPPORT)
    )
    totals = sample.agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).first()
    if not totals.n or not totals.toxic or totals.toxic == totals.n:
        return []
    clean = totals.n - totals.toxic
    ratio = F.log(((F.col("toxic") + 0.5) / (totals.toxic + 1)) / ((F.col("n") - F.col("toxic") + 0.5) / (clean + 1)))
    # few by the support: at most (words of the bounded sample) / MIN_SUPPORT
    found = {r.stem: (r.toxic, r.ratio) for r in counted.withColumn("ratio", ratio).where(F.col("ratio") >= MIN_LOG_RATIO).collect()}
    # a term: no shorter beginning is as telling, and no longer one holds nearly all of its documents
    terms = {}
    for stem in sorted(found, key=lambda s: (len(s), s)):
        if any(stem[:k] in found for k in range(MIN_STEM, len(stem))):
            continue
        while True:
            longer = [s for s in found if len(s) == len(stem) + 1 and s.startswith(stem) and found[s][0] >= 0.95 * found[stem][0]]
            if not longer:
                break
            stem = longer[0]
        terms[stem] = found[stem]
    best = sorted(terms, key=lambda s: (-terms[s][0] * terms[s][1], s))[:MAX_TERMS]
    return [(s.rstrip("$"), s.endswith("$")) for s in sorted(best)]


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.deviation
        return sigmoid(np.column_stack([z, np.ones(len(z))]) @ self.weights)


def _feature_batches(batches: Iterator, lexicon) -> Iterator:
    for batch in batches:
        for piece in slices(batch):
            x = features(piece.column("text"), lexicon.value)
            yield pa.RecordBatch.from_arrays([piece.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def _score_batches(batches: Iterator, model) -> Iterator:
    for batch in batches:
        for piece in slices(batch):
            score = model.value.score(features(piece.column("text"), model.value.lexicon))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def learn(sample: DataFrame) -> Model:
    """Lexicon and weights from a bounded table (doc_id, text, y) of lower-case texts."""
    lexicon = Lexicon(learn_lexicon(sample))
    shared = Sent(sample.sparkSession, lexicon)
    rows = sample.mapInArrow(lambda b: _feature_batches(b, shared), "y INT, x ARRAY<DOUBLE>").collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), FEATURES)
    y = np.array([r.y for r in rows], float)
    mean, deviation = standardized(x)
    inputs = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
    return Model(lexicon, mean, deviation, logistic(inputs, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = Sent(docs.sparkSession, model)
    lowered = texts_of(docs).withColumn("text", F.lower("text"))
    return lowered.mapInArrow(lambda b: _score_batches(b, shared), "doc_id LONG, score DOUBLE")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = texts_of(docs).withColumn("text", F.lower("text"))
    model = learn(labelled_sample(lowered, table(spark, sf_dir, "labels"), "toxic", 3, 1, MAX_TRAIN).persist())
    return score(docs, model).select(
        "doc_id",
        (crc32_remainder(3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
