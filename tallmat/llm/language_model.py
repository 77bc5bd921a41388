"""LM scoring by a hierarchical Pitman-Yor model.

Every token is a customer in the restaurant of its context, the word before; every word has a restaurant of its own. A
table of a context restaurant sends one customer to the unigram restaurant, the parent that all contexts share; its base
measure spreads over the known words and one event for all unknown words, which gets their Good-Turing share. The
seating is sampled by Gibbs, in the contexts and in the parent: a step seats all customers of a word in a context anew by
drawing the number of their tables given all others (`tallmat.llm.seating`); predictive probabilities need no more than
these numbers. The score averages the predictive probabilities of several samples.

How it is distributed: documents are cut into chunks of a few million tokens. A chunk keeps its tokens as numbers into
its own sorted vocabulary, and sends its distinct words and (word, context) pairs, with training counts, to buckets of
word hashes. A bucket holds some words completely, in all their contexts, so it can seat them alone; buckets only share
the totals per context. The first pass over the buckets seats and deals the customers and tables of each bucket's contexts
over places, by ranges of the context's hash. A place adds up its contexts and answers every bucket with the totals of those
it named. The second pass seats again, samples with these totals, and answers every chunk with the probabilities of its
pairs. Chunks then add up their documents. Words, as such and as contexts, are told apart by 64-bit hashes; in what chunks
send, contexts from a book of frequent words go by their place in it, which shortens the records and changes nothing else.

Defined cases: letters A-Z are compared without case; a NULL or empty text is the end token alone, which follows the
context of a text's begin; with no training documents every token is unknown; repeated rows are counted and scored each;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallmat.llm.common import Sent, query, stored, table, texts_of
from tallmat.llm.near_dedup import _groups
from tallmat.llm.seating import draw_tables
from tallmat.llm.words import Words, slices

# Up to so many contexts of a record are numbered by two bytes, more by four.
CONTEXTS = 1 << 16
CHUNK_TOKENS = 4_000_000
BUCKET_BYTES = 32 << 20
STRENGTH, PARENT_STRENGTH = 1.0, 10.0
BURN_IN, SAMPLES = 2, 3
HELD_OUT = 10
_END = np.uint64(0x2545F4914F6CDD1D)
_BEGIN = np.uint64(0x6A09E667F3BCC909)
# The book of frequent words comes from the beginnings of a few documents.
BOOK, BOOK_DOCUMENTS, BOOK_LETTERS = 1 << 16, 4000, 20_000
_NO_BOOK = np.empty(0, np.uint64)
# Values looked up at once.
_PIECE = 1 << 18


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % HELD_OUT == 0


def _packed(x: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(body: bytes, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def _steps(x: np.ndarray) -> bytes:
    """Ascending hashes by their differences."""
    return _packed(np.diff(x, prepend=np.uint64(0)))


def _ascending(body: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(body, "u8"), dtype=np.uint64)


def _named(x: np.ndarray, book: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending hashes: places of those in the book, and the others."""
    if not len(book):
        return _packed(np.empty(0, np.uint16)), _steps(x)
    place = np.minimum(np.searchsorted(book, x), len(book) - 1)
    inside = book[place] == x
    return _packed(np.diff(place[inside], prepend=0).astype(np.uint16)), _steps(x[~inside])


def _names(places: bytes, others: bytes, book: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([book[np.cumsum(_unpacked(places, "u2"), dtype=np.int64)], _ascending(others)]))


def _bodies(group: pa.Table, name: str) -> list[pa.Buffer]:
    """The bytes of a column, not copied."""
    return [v.as_buffer() for v in group.column(name)]


def _number_kind(contexts: int) -> str:
    return "u2" if contexts <= CONTEXTS else "u4"


_BODIES = list("abcdefg")
CHUNK_SCHEMA = "chunk LONG, bucket INT, doc_ids ARRAY<LONG>, " + ", ".join(f"{c} BINARY" for c in _BODIES)
TOTAL_SCHEMA = "place INT, bucket INT, a BINARY, b BINARY, c BINARY"


def _record(chunk: int, bucket: int, doc_ids: list[int], *bodies: bytes) -> pa.RecordBatch:
    values = [[chunk], [bucket], [doc_ids], *[[b] for b in bodies], *[[None]] * (len(_BODIES) - len(bodies))]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * len(_BODIES)]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["chunk", "bucket", "doc_ids", *_BODIES])


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and the number of each value among them; only the distinct ones are sorted."""
    found = pa.array(x).dictionary_encode()
    order = np.argsort(found.dictionary.to_numpy())
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(len(order), dtype=np.uint32)
    return found.dictionary.to_numpy()[order], number[found.indices.to_numpy()]


def _keys(word: np.ndarray, context: np.ndarray, contexts: int) -> np.ndarray:
    """(word, context) as word * contexts + context."""
    key = word.astype(np.int64)
    key *= contexts
    key += context
    return key


def _begins(x: np.ndarray) -> np.ndarray:
    """Whether a value of an ascending array is the first of its kind."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def _sums_at(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """np.bincount of long short-typed arrays, without whole copies of them."""
    out = np.zeros(n)
    for a in range(0, len(at), max(_PIECE, n)):
        out += np.bincount(at[a : a + max(_PIECE, n)], x[a : a + max(_PIECE, n)], n)
    return out


def _places(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of every value of x, all of them among the ascending keys."""
    out = np.empty(len(x), np.int32)
    for a in range(0, len(x), _PIECE):
        out[a : a + _PIECE] = np.searchsorted(keys, x[a : a + _PIECE])
    return out


def _chunk_rows(chunk: int, tokens: np.ndarray, contexts: np.ndarray, train: np.ndarray, doc_ids: list[int], lengths: np.ndarray, buckets: int, book: np.ndarray = _NO_BOOK):
    # arrays of tokens are long: numbers go into four bytes, nothing long is sorted with its places, and what is done with goes
    vocabulary, word = _coded(tokens)
    del tokens
    names, context = _coded(contexts.astype(np.uint64, copy=False))
    del contexts
    # one more bit tells the tokens of training documents
    key = _keys(word, context, len(names))
    del context
    key *= 2
    key += train.astype(np.uint8)
    key.sort()
    words_train = np.bincount(word, train, len(vocabulary)).astype(np.uint32)
    del train
    odd = (key & 1).astype(bool)
    key >>= 1
    first = np.flatnonzero(_begins(key))
    pairs = key[first]
    del key
    pairs_train = np.add.reduceat(odd, first, dtype=np.uint32) if len(first) else np.empty(0, np.uint32)
    del odd, first
    pair_context = (pairs % len(names)).astype(np.uint32)
    per_word = np.bincount(pairs // len(names), minlength=len(vocabulary)).astype(np.uint32)
    del pairs
    # frequent words get small numbers, which compress well
    order = np.argsort(-np.bincount(word), kind="stable")
    short = np.empty(len(order), np.uint32)
    short[order] = np.arange(len(order))
    # the number of each word as a context; that of a text's begin comes last
    as_context = np.searchsorted(names, np.append(vocabulary, _BEGIN)).astype(np.uint32)
    yield _record(chunk, -1, doc_ids, _packed(lengths.astype(np.uint32)), _packed(short[word]), _packed(order.astype(np.uint32)), _packed(as_context), _packed(np.array([len(names)], np.uint32)))
    edges = np.searchsorted(vocabulary, bucket_edges(buckets))
    pair_edges = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])[edges]
    for k in range(buckets):
        a, b = edges[k], edges[k + 1]
        if a < b:
            p, q = pair_edges[k], pair_edges[k + 1]
            used, number = np.unique(pair_context[p:q], return_inverse=True)
            number = number.astype(_number_kind(len(used)))
            yield _record(chunk, k, [], _steps(vocabulary[a:b]), _packed(words_train[a:b]), _packed(per_word[a:b]), _packed(number), _packed(pairs_train[p:q]), *_named(names[used], book))


def bucket_edges(buckets: int) -> np.ndarray:
    """Word hashes at which buckets begin, and an end beyond all of them."""
    step = (1 << 64) // buckets
    return np.array([k * step for k in range(buckets)] + [(1 << 64) - 1], np.uint64)


def _chunk_batches(batches: Iterator, buckets: int, book) -> Iterator:
    part = TaskContext.get().partitionId()
    number = 0
    held: list[tuple] = []
    size = 0

    def flush():
        nonlocal number, size
        ids, lengths = [i for h in held for i in h[1]], np.concatenate([h[2] for h in held])
        tokens = np.concatenate([h[0] for h in held])
        held.clear()
        contexts = np.empty(len(tokens), np.uint64)
        contexts[1:] = tokens[:-1]
        contexts[np.cumsum(lengths) - lengths] = _BEGIN
        train = np.repeat(np.array([not held_out(i) for i in ids], bool), lengths)
        rows = _chunk_rows((part << 24) + number, tokens, contexts, train, ids, lengths, buckets, book.value)
        number, size = number + 1, 0
        return rows

    for batch in batches:
        for piece in slices(batch):
            words = Words(piece.column("text"), lower=True)
            lengths = words.counts + 1
            tokens = np.full(int(lengths.sum()), _END, np.uint64)
            last = np.cumsum(lengths) - 1
            inside = np.ones(len(tokens), bool)
            inside[last] = False
            # the largest hash is the end of the last bucket, so no word may have it
            tokens[inside] = np.minimum(words.hashes(), np.uint64((1 << 64) - 2))
            held.append((tokens, piece.column("doc_id").to_pylist(), lengths))
            size += len(tokens)
            if size >= CHUNK_TOKENS:
                yield from flush()
    if held:
        yield from flush()


@dataclass
class Totals:
    """What buckets share: customers and tables of a bucket's contexts, and sums over all words."""

    customers: np.ndarray | None
    tables: np.ndarray | None
    discount: float
    parent_discount: float
    parent_customers: float
    parent_tables: float
    words: float
    tokens: float
    unknown: float
    # how many times the tables of other words are to be counted: more than once where the rest is a guess
    times: float = 1.0

    def base(self) -> float:
        return (1 - self.unknown) / max(self.words, 1.0)

    def parent(self, n: np.ndarray, t: np.ndarray, base: float) -> np.ndarray:
        """Probability of words in the unigram restaurant."""
        fresh = PARENT_STRENGTH + self.parent_discount * self.parent_tables
        seated = np.maximum(n - self.parent_discount * t, 0)
        return (seated + fresh * base) / (PARENT_STRENGTH + self.parent_customers)


class Bucket:
    """Some words with all their contexts, merged from the rows of all chunks."""

    def __init__(self, group: pa.Table, book: np.ndarray = _NO_BOOK):
        self.chunks = group.column("chunk").to_pylist()
        read = lambda name, kind: np.concatenate([_unpacked(b, kind) for b in _bodies(group, name)])
        words = [_ascending(b) for b in _bodies(group, "a")]
        vocabulary, word = np.unique(np.concatenate(words), return_inverse=True)
        per_word = read("c", "u4").astype(np.int64)
        self.word_rows = np.cumsum([0] + [len(w) for w in words])
        self.pair_rows = np.concatenate([[0], np.cumsum(per_word)])[self.word_rows]
        names = [_names(f, g, book) for f, g in zip(_bodies(group, "f"), _bodies(group, "g"))]
        first = np.cumsum([0] + [len(n) for n in names])
        # the contexts of these words, by hash
        joined = np.concatenate(names)
        self.contexts = np.unique(joined)
        place = _places(self.contexts, joined)
        del names, joined
        # arrays of pairs are long: they are filled chunk by chunk, and what is done with goes
        key = np.empty(self.pair_rows[-1], np.int64)
        for k, body in enumerate(_bodies(group, "d")):
            rows = slice(self.word_rows[k], self.word_rows[k + 1])
            context = place[first[k] : first[k + 1]][_unpacked(body, _number_kind(first[k + 1] - first[k]))]
            key[self.pair_rows[k] : self.pair_rows[k + 1]] = _keys(np.repeat(word[rows], per_word[rows]), context, len(self.contexts))
        del place, per_word
        pairs = np.sort(key)
        pairs = pairs[_begins(pairs)]
        self.pair_of = _places(pairs, key)
        del key
        self.word_of = word
        self.count = np.bincount(word, read("b", "u4"), len(vocabulary))
        self.word, self.context = (pairs // len(self.contexts)).astype(np.int32), (pairs % len(self.contexts)).astype(np.int32)
        self.customers = np.zeros(len(pairs), np.int64)
        del pairs
        for k, body in enumerate(_bodies(group, "e")):
            # a chunk names a pair once
            self.customers[self.pair_of[self.pair_rows[k] : self.pair_rows[k + 1]]] += _unpacked(body, "u4")
        self.draw = np.random.default_rng([17, group.column("bucket")[0].as_py()])
        # no table count is drawn yet: 0 for pairs, one table a word in the parent; a single customer has one table always
        self.tables = np.minimum(self.customers, 1)
        self.several = np.flatnonzero(self.customers > 1).astype(np.int32)
        self.drawn = np.zeros(len(self.several), np.int64)
        self.parent_drawn = np.zeros(len(vocabulary), np.int64)
        self._count_parent()

    def _count_parent(self) -> None:
        self.parent_customers = _sums_at(self.word, self.tables, len(self.count))
        self.parent_tables = np.where(self.parent_drawn > 0, self.parent_drawn, np.minimum(self.parent_customers, 1))

    def of_contexts(self, x: np.ndarray) -> np.ndarray:
        return _sums_at(self.context, x, len(self.contexts))

    def sweep(self, totals: Totals) -> None:
        """Every customer seated anew: the tables of all pairs given the parent, then those of the words in the parent."""
        d, parent = totals.discount, totals.parent(self.parent_customers, self.parent_tables, totals.base())
        busy = self.several
        others = STRENGTH + d * totals.times * np.maximum(totals.tables[self.context[busy]] - self.tables[busy], 0)
        self.drawn = draw_tables(self.drawn, self.customers[busy], parent[self.word[busy]], others, d, self.draw)
        self.tables[busy] = self.drawn
        self._count_parent()
        known = np.flatnonzero(self.parent_customers)
        seated = self.parent_customers[known].astype(np.int64)
        d = totals.parent_discount
        rest = PARENT_STRENGTH + d * np.maximum(totals.parent_tables - self.parent_tables[known], 0)
        before = np.minimum(self.parent_drawn[known], seated)
        self.parent_drawn[known] = draw_tables(before, seated, np.full(len(known), totals.base()), rest, d, self.draw)
        self._count_parent()

    def probability(self, totals: Totals, times: float = 1.0, total: np.ndarray | None = None) -> np.ndarray:
        """`total` plus, `times` over, the predictive probability of every (word, context) pair, seen or not."""
        parent = np.where(
            self.count > 0,
            totals.parent(self.parent_customers, self.parent_tables, totals.base()),
            totals.parent(np.zeros(len(self.count)), np.zeros(len(self.count)), totals.unknown),
        )
        total = np.zeros(len(self.word)) if total is None else total
        for a in range(0, len(total), _PIECE):
            here = slice(a, a + _PIECE)
            context, tables = self.context[here], self.tables[here]
            seated = STRENGTH + totals.customers[context]
            own = np.maximum(self.customers[here] - totals.discount * tables, 0)
            total[here] += (own + (STRENGTH + totals.discount * totals.tables[context]) * parent[self.word[here]]) / seated * times
        return total


def _first_totals(bucket: Bucket, buckets: int) -> Totals:
    """A guess from one bucket, for burn-in only: its words are a random part of all words."""
    tables = bucket.of_contexts(bucket.tables)
    known = float((bucket.count > 0).sum() * buckets)
    # a word's own tables are no part of the guess, so the rest is multiplied where they are taken off
    return Totals(bucket.of_contexts(bucket.customers), tables, 0.8, 0.6, float(tables.sum()) * buckets, known, known, float(bucket.customers.sum()) * buckets, 0.5, buckets)


def _burnt_in(group: pa.Table, buckets: int, book: np.ndarray) -> Bucket:
    bucket = Bucket(group, book)
    for _ in range(BURN_IN):
        bucket.sweep(_first_totals(bucket, buckets))
    return bucket


def _total_record(place: int, bucket: int, *bodies: bytes) -> pa.RecordBatch:
    values = [[place], [bucket], *[[b] for b in bodies], *[[None]] * (3 - len(bodies))]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["place", "bucket", "a", "b", "c"])


def _total_batches(batches: Iterator, buckets: int, book) -> Iterator:
    """Burn-in of every bucket: customers and tables of its contexts, by places; sums over all words as place -1."""
    sums = np.zeros(10)
    for group in _groups(batches, "bucket"):
        bucket = _burnt_in(group, buckets, book.value)
        number = group.column("bucket")[0].as_py()
        customers, tables = [bucket.of_contexts(x).astype(np.uint64) for x in (bucket.customers, bucket.tables)]
        edges = np.searchsorted(bucket.contexts, bucket_edges(buckets))
        for place, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a < b:
                yield _total_record(place, number, _steps(bucket.contexts[a:b]), _packed(customers[a:b]), _packed(tables[a:b]))
        ones = [(x == k).sum() for x in (bucket.customers, bucket.parent_customers, bucket.count) for k in (1, 2)]
        sums += [(bucket.count > 0).sum(), bucket.count.sum(), bucket.parent_tables.sum(), *ones, bucket.tables.sum()]
    yield _total_record(-1, -1, sums.tobytes())


def _place_batches(batches: Iterator) -> Iterator:
    """Totals of the contexts of a place, for every bucket those it named, in its order."""
    for group in _groups(batches, "place"):
        rows = group.to_pylist()
        names = [_ascending(r["a"]) for r in rows]
        contexts, at = np.unique(np.concatenate(names), return_inverse=True)
        totals = [
            np.bincount(at, np.concatenate([_unpacked(r[k], "u8") for r in rows]), len(contexts)).astype(np.uint64) for k in "bc"
        ]
        ends = np.cumsum([len(n) for n in names])
        for r, n, end in zip(rows, names, ends):
            own = at[end - len(n) : end]
            yield _record(-1 - r["place"], r["bucket"], [], *[_packed(t[own]) for t in totals])


def _sums(partial: DataFrame) -> Totals:
    """Sums over all buckets, without totals of contexts."""
    sums = sum((np.frombuffer(bytes(r.a)) for r in partial.where("place < 0").select("a").collect()), np.zeros(10))
    words, tokens, parent_tables, p1, p2, q1, q2, w1, _, tables = sums
    estimate = lambda one, two: float(np.clip(one / (one + 2 * two), 0.1, 0.95)) if one + two else 0.75
    out = Totals(None, None, estimate(p1, p2), estimate(q1, q2), tables, parent_tables, words, tokens, 0.5)
    fresh = (PARENT_STRENGTH + out.parent_discount * parent_tables) / (PARENT_STRENGTH + out.parent_customers)
    if tokens:
        out.unknown = float(np.clip((w1 + 1) / (tokens + 1) / fresh, 0.01, 0.9))
    return out


def _answer_batches(batches: Iterator, buckets: int, book, totals) -> Iterator:
    """Samples of every bucket; per chunk the training counts of its words and the log probabilities of its pairs."""
    for group in _groups(batches, "bucket"):
        # places come first, that of the highest hashes at the head
        n = int((group.column("chunk").to_numpy() < 0).sum())
        customers, tables = [
            np.concatenate([_unpacked(b, "u8") for b in _bodies(group.slice(0, n), k)[::-1]]).astype(float) for k in "ab"
        ]
        bucket = _burnt_in(group.slice(n), buckets, book.value)
        known = replace(totals.value, customers=customers, tables=tables)
        mean = np.zeros(len(bucket.word))
        for _ in range(SAMPLES):
            bucket.sweep(known)
            mean = bucket.probability(known, 1 / SAMPLES, mean)
        score = np.log10(mean, out=mean).astype(np.float32)[bucket.pair_of]
        del mean
        count = bucket.count.astype(np.uint32)[bucket.word_of]
        number = group.column("bucket")[0].as_py()
        for i, chunk in enumerate(bucket.chunks):
            a = count[bucket.word_rows[i] : bucket.word_rows[i + 1]]
            b = score[bucket.pair_rows[i] : bucket.pair_rows[i + 1]]
            yield _record(chunk, number, [], _packed(a), _packed(b))


def _score_batches(batches: Iterator, words: float, tokens: float) -> Iterator:
    """Scores of the documents of each chunk from the answers of all buckets."""
    for group in _groups(batches, "chunk"):
        # the stream has bucket -1
        stream = group.slice(0, 1).to_pylist()[0]
        count = np.concatenate([_unpacked(b, "u4") for b in _bodies(group.slice(1), "a")]).astype(float)
        score = np.concatenate([_unpacked(b, "f4") for b in _bodies(group.slice(1), "b")])
        lengths = _unpacked(stream["a"], "u4").astype(np.int64)
        word = _unpacked(stream["c"], "u4")[_unpacked(stream["b"], "u4")]
        as_context = _unpacked(stream["d"], "u4")
        contexts = np.empty(len(word), np.uint32)
        contexts[1:] = as_context[word[:-1]]
        ends = np.cumsum(lengths)
        contexts[ends - lengths] = as_context[-1]
        key = _keys(word, contexts, int(_unpacked(stream["e"], "u4")[0]))
        del contexts
        pairs = np.sort(key)
        pairs = pairs[_begins(pairs)]
        pair = _places(pairs, key)
        del key, pairs
        base = np.log10((count + 0.1) / (tokens + 0.1 * (words + 1)))[word]
        sums = lambda v: np.add.reduceat(v, ends - lengths)
        ids = stream["doc_ids"]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([held_out(i) for i in ids]),
                pa.array(lengths),
                pa.array(sums((count[word] > 0).astype(np.int64))),
                pa.array(np.full(len(ids), int(tokens), np.int64)),
                pa.array(sums(base)),
                pa.array(sums(score[pair].astype(float))),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def _count_batches(batches: Iterator) -> Iterator:
    for batch in batches:
        word, n = np.unique(Words(batch.column("text"), lower=True).hashes(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


def _book(texts: DataFrame, n: int) -> np.ndarray:
    """Hashes of frequent words in about `BOOK_DOCUMENTS` of n documents, ascending."""
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(n // BOOK_DOCUMENTS + 1)) == 0
    some = texts.where(chosen).select(F.substring("text", 1, BOOK_LETTERS).alias("text"))
    counts = some.mapInArrow(_count_batches, "word LONG, n LONG").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "word").limit(BOOK).select("word").collect()
    return np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    texts = texts_of(docs)
    size, n = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = int((size or 0) // BUCKET_BYTES) + 1
    book = Sent(spark, _book(texts, n))
    chunks = stored(texts.mapInArrow(lambda b: _chunk_batches(b, buckets, book), CHUNK_SCHEMA), "chunks")
    by_bucket = chunks.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket", "chunk")
    partial = stored(by_bucket.mapInArrow(lambda b: _total_batches(b, buckets, book), TOTAL_SCHEMA), "context-totals")
    totals = _sums(partial)
    shared = Sent(spark, totals)
    by_place = partial.where("place >= 0").repartition("place").sortWithinPartitions("place", "bucket")
    named = by_place.mapInArrow(_place_batches, CHUNK_SCHEMA)
    met = chunks.where("bucket >= 0").unionByName(named).repartition("bucket").sortWithinPartitions("bucket", "chunk")
    answers = met.mapInArrow(lambda b: _answer_batches(b, buckets, book, shared), CHUNK_SCHEMA)
    streams = chunks.where("bucket < 0")
    words, tokens = totals.words, totals.tokens
    return (
        streams.unionByName(answers)
        .repartition("chunk")
        .sortWithinPartitions("chunk", "bucket")
        .mapInArrow(
            lambda b: _score_batches(b, words, tokens),
            "doc_id LONG, held_out BOOLEAN, n_tokens LONG, n_known LONG, train_tokens LONG, base_score DOUBLE, score DOUBLE",
        )
    )


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, tokens, perplexity) over all documents of each part."""
    total = F.sum("n_tokens").alias("tokens")
    return scores.groupBy("held_out").agg(total, F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))


@query("op4_language_model")
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
