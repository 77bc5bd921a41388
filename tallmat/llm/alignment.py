"""Cross-tokenizer alignment by interval coalescing.

Tokenizer A is a byte-level BPE of the `tokenizers` library and encodes a space and the text; B is a `sentencepiece` model,
which adds that space itself. Both token rows cover the same bytes, so a token is an interval of byte places. All A and B
tokens of many documents are lexsorted by start at once, `maximum.accumulate` runs over their ends, and a group breaks
where a start reaches the running maximum: there both tokenizers end a token. Inside the groups every overlap of an A with
a B token expands to a link.

How often an id pair is linked in the whole corpus is counted in Spark. Documents are packed into slices of about
`SLICE_TOKENS` tokens; a slice holds its distinct pairs once and every link as the number of its pair, so what is shuffled
for counts and for looking them up are the distinct pairs of slices, and no table of pairs is broadcast. A pair has at
most one row per slice, so none can fill a task.

Defined cases: NULL and empty texts have no tokens, nor have texts whose joined A or B tokens differ from a space and the
text (a sentencepiece model may rewrite characters); their lists are empty and their counts 0. Strings of special tokens
are plain text. Rows without an id are left out, repeated rows count each, an empty table gives no rows, extra columns are
ignored. A text of any length is handled whole, in a slice of its own if need be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallmat.llm.common import query, stored, table, texts_of
from tallmat.llm.tokens import Encoder, tokenizer_path
from tallmat.llm.words import lists, ranges, slices

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
# Bytes of text encoded at once, and tokens of both kinds in a slice; one longer text makes a slice of its own.
SLICE_TEXT = 1 << 19
SLICE_TOKENS = 1 << 19
# Stretches of text remembered by a task, which has two tokenizers to hold.
MAX_KNOWN = 150_000

ALIGNED = "doc_id LONG, a ARRAY<INT>, b ARRAY<INT>, group_a ARRAY<INT>, group_b ARRAY<INT>"


class TokenBytes:
    """The bytes of every id of a vocabulary, one after the other."""

    def __init__(self, names: list[bytes]):
        self.length = np.array([len(x) for x in names], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(names), np.uint8)

    def __len__(self) -> int:
        return len(self.length)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        return self.flat[np.repeat(self.start[ids], length) + ranges(length)]


def byte_level_tokens(path: str) -> TokenBytes:
    """Bytes of a byte-level vocabulary: printable bytes stand for themselves, the others for characters from 256 on."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    tokenizer = Tokenizer.from_file(path)
    names = (tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size()))
    return TokenBytes([bytes(byte_of[c] for c in n) if all(c in byte_of for c in n) else n.encode() for n in names])


def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_tokens(model) -> TokenBytes:
    """Bytes of a sentencepiece vocabulary: U+2581 is a space, <0xHH> a byte."""
    pieces = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return TokenBytes([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces])


def encode_pieces(model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one text after the other, and the number of ids per text."""
    found = model.encode(texts, num_threads=1)
    counts = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts


def _of_texts(values: np.ndarray, counts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    return values[np.repeat(chosen, counts)]


def same_bytes(tokens: TokenBytes, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts are the joined bytes of their tokens."""
    upto = np.concatenate([[0], np.cumsum(tokens.length[ids])])
    size = np.diff(upto[np.concatenate([[0], np.cumsum(counts)])])
    fits = size == np.diff(offsets)
    inside = np.repeat(fits, np.diff(offsets))
    differ = np.flatnonzero(tokens.joined(_of_texts(ids, counts, fits)) != data[inside])
    ends = np.cumsum(size[fits])
    wrong = np.flatnonzero(fits)[np.unique(np.searchsorted(ends, differ, side="right"))]
    fits[wrong] = False
    return fits


def coalesce(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A and each B token, for two rows of tokens over the same bytes."""
    end = np.concatenate([np.cumsum(length_a), np.cumsum(length_b)])
    start = end - np.concatenate([length_a, length_b])
    side = np.repeat([0, 1], [len(length_a), len(length_b)])
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(length_a)], group[len(length_a) :]


def overlaps(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (A token, B token) whose bytes overlap, ordered by place."""
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    first = np.searchsorted(end_b, end_a - length_a, side="right")
    last = np.searchsorted(end_b - length_b, end_a, side="left")
    counts = last - first
    return np.repeat(np.arange(len(length_a)), counts), np.repeat(first, counts) + ranges(counts)


def _align_batches(batches: Iterator, path_a: str, path_b: str) -> Iterator:
    encoder, model = Encoder(path_a, spaces=True, max_known=MAX_KNOWN), piece_model(path_b)
    bytes_a, bytes_b = byte_level_tokens(path_a), piece_tokens(model)
    for batch in batches:
        for part in slices(batch, limit=SLICE_TEXT):
            texts = part.column("text").cast(pa.large_string()).fill_null("")
            some = pc.binary_length(texts).to_numpy() > 0
            texts = texts.filter(pa.array(some))
            spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
            offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
            data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            a, n_a = encoder.encode(spaced)
            a = a.astype(np.int64)
            b, n_b = encode_pieces(model, texts.to_pylist())
            fits = same_bytes(bytes_a, a, n_a, data, offsets) & same_bytes(bytes_b, b, n_b, data, offsets)
            a, b = _of_texts(a, n_a, fits), _of_texts(b, n_b, fits)
            counts = np.zeros((3, part.num_rows), np.int64)
            rows = np.flatnonzero(some)[fits]
            counts[0, rows], counts[1, rows] = n_a[fits], n_b[fits]
            group_a, group_b = coalesce(bytes_a.length[a], bytes_b.length[b])
            # all tokens of a document before the next one's, so the last group of each is that of its last token
            if len(rows):
                counts[2, rows] = np.diff(group_a[np.cumsum(n_a[fits]) - 1], prepend=-1)
            n_groups = int(counts[2].sum())
            columns = [
                part.column("doc_id"),
                lists(a.astype(np.int32), counts[0], pa.int32()),
                lists(b.astype(np.int32), counts[1], pa.int32()),
                lists(np.bincount(group_a, minlength=n_groups).astype(np.int32), counts[2], pa.int32()),
                lists(np.bincount(group_b, minlength=n_groups).astype(np.int32), counts[2], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "b", "group_a", "group_b"])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, a, b, group_a, group_b): ids of both tokenizers, and how many A and B tokens each group has, in order."""
    path_a, path_b = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)
    return texts_of(docs).mapInArrow(lambda batches: _align_batches(batches, path_a, path_b), ALIGNED)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy().astype(np.int64)


def _token_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(_flat(batch.column("a"))[1] + _flat(batch.column("b"))[1])
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE_TOKENS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which lets the planes of zeros vanish in compression."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _group_digests(a, n_a, b, n_b, group_a, group_b, n_groups, decimals: list[str]) -> list[str]:
    """sha256 of `a1,a2|b1;a3|b2,b3` per document; `decimals` has all ids with a comma, a bar and a semicolon behind."""
    size = len(decimals) // 3
    sizes = np.column_stack([group_a, group_b]).reshape(-1)
    # tokens in the order of the text: of each group first A's, then B's
    numbers = np.arange(len(sizes)).reshape(-1, 2)
    key = np.concatenate([np.repeat(numbers[:, 0], group_a), np.repeat(numbers[:, 1], group_b)])
    order = np.argsort(key, kind="stable")
    sign = np.zeros(len(order), np.int64)
    sign[np.cumsum(sizes) - 1] = np.tile([1, 2], len(group_a))
    at = (np.concatenate([a, b])[order] + size * sign).tolist()
    out, begin = [], 0
    for n in (n_a + n_b).tolist():
        text = "".join(map(decimals.__getitem__, at[begin : begin + n]))[:-1]
        out.append(hashlib.sha256(text.encode()).hexdigest() if n else "")
        begin += n
    return out


SLICES = (
    "slice LONG, doc_id ARRAY<LONG>, n_a ARRAY<LONG>, n_b ARRAY<LONG>, n_groups ARRAY<LONG>, n_links ARRAY<LONG>, "
    "digest ARRAY<STRING>, links BINARY, pairs ARRAY<LONG>, times ARRAY<LONG>"
)


def _pack_batches(batches: Iterator, path_a: str, path_b: str) -> Iterator:
    bytes_a, bytes_b = byte_level_tokens(path_a), piece_tokens(piece_model(path_b))
    decimals = [f"{i}{sign}" for sign in ",|;" for i in range(max(len(bytes_a), len(bytes_b)))]
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in _token_slices(batch):
            a, n_a = _flat(part.column("a"))
            b, n_b = _flat(part.column("b"))
            group_a, n_groups = _flat(part.column("group_a"))
            group_b, _ = _flat(part.column("group_b"))
            i, j = overlaps(bytes_a.length[a], bytes_b.length[b])
            doc_of_a = np.repeat(np.arange(part.num_rows), n_a)
            n_links = np.bincount(doc_of_a[i], minlength=part.num_rows)
            pairs, at, times = np.unique(a[i] * len(bytes_b) + b[j], return_inverse=True, return_counts=True)
            digests = _group_digests(a, n_a, b, n_b, group_a, group_b, n_groups, decimals)
            row = {
                "slice": number, "doc_id": part.column("doc_id").to_numpy(), "n_a": n_a, "n_b": n_b, "n_groups": n_groups,
                "n_links": n_links, "digest": digests, "links": _planes(at), "pairs": pairs, "times": times,
            }
            number += 1
            columns = [
                pa.array([v], t)
                for v, t in zip(row.values(), [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.binary(), *[pa.list_(pa.int64())] * 2])
            ]
            yield pa.RecordBatch.from_arrays(columns, names=list(row))


def pack_links(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Slices of the aligned documents with their links, stored; a text is encoded, aligned and packed in one task.

    A row has its documents' counts and digests, its distinct pairs (A id x size of B + B id) with their number, and every link as
    the place of its pair.
    """
    path_a, path_b = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)

    def run(batches):
        return _pack_batches(_align_batches(batches, path_a, path_b), path_a, path_b)

    return stored(texts_of(docs).mapInArrow(run, SLICES), "links")


def pair_counts(packed: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, b, n, best): links of each id pair in the corpus, and whether no other A id has more with that B id."""
    each = packed.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.select("pair", F.expr(f"pair DIV {size_b}").cast("int").alias("a"), F.pmod("pair", F.lit(size_b)).cast("int").alias("b"), "n")
    # a B id has at most one row per id of A here
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _sum_batches(batches: Iterator) -> Iterator:
    for batch in batches:
        for r in range(batch.num_rows):
            row = {name: batch.column(name)[r] for name in batch.schema.names}
            doc = row["doc_id"].values.to_numpy()
            n_links = row["n_links"].values.to_numpy()
            found = row["found"].values
            place = found.field("place").to_numpy() if found is not None else np.zeros(0, np.int64)
            count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            if len(place):
                count[place], best[place] = found.field("n").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
            links = _from_planes(row["links"].as_py())
            upto = np.concatenate([[0], np.cumsum(n_links)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[upto]) for x in (best, count)]
            columns = [pa.array(doc), *(row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")), *(pa.array(s) for s in sums), row["digest"].values]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            )


def link_statistics(packed: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document: tokens, groups, links, links of a B id's most frequent pair, the sum of all links' counts, and the digest."""
    wanted = packed.select("slice", F.posexplode("pairs").alias("place", "pair"))
    looked = wanted.join(counts.select("pair", "n", "best"), "pair")
    found = looked.groupBy("slice").agg(F.collect_list(F.struct("place", "n", "best")).alias("found"))
    rows = packed.drop("pairs", "times").join(found, "slice", "left")
    schema = "doc_id LONG, n_a LONG, n_b LONG, n_groups LONG, n_links LONG, n_best LONG, count_sum LONG, groups_sha256 STRING"
    return rows.mapInArrow(_sum_batches, schema)


@query("op13_cross_tokenizer_alignment")
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_links(table(spark, sf_dir, "documents"))
    size_b = len(piece_tokens(piece_model(tokenizer_path(TOKENIZER_B))))
    return link_statistics(packed, pair_counts(packed, size_b))
