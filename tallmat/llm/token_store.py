"""Token-ID output: a binary format for token ids, compressed by a grammar per block.

Documents are dealt into ranges of doc_id, sorted, encoded and written as blocks of about a million ids. Within a block
Re-Pair replaces frequent pairs of neighbouring ids by new symbols (nonterminals), round after round: all pairs found
at least `MIN_COUNT` times are replaced in one round, the more frequent one wherever two overlap, until no pair is
frequent or a round no longer pays. Symbol V + k stands for the k-th rule (V: size of the vocabulary).

The file format is a Parquet table with one row per block: `part` and `block` order the blocks; `doc_ids` and `ends`
(ids up to and with each document) locate documents; `rules` holds two symbols per rule, `rule_lengths` the ids that
each rule expands to, and `symbols` the block itself (little-endian unsigned 32-bit integers). `decode` expands any
stretch of a block without the rest of it, because the lengths tell which symbols cover the stretch.

Defined cases: NULL and empty texts have the end id only; rows with equal doc_id are all stored, in the order of their
texts, rows equal altogether one after the other; an empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallmat.llm.common import cut_lineage, query, table, texts_of
from tallmat.llm.tokens import TOKEN_SLICE, Encoder, crc, tokenizer_path, with_end
from tallmat.llm.words import slices
from tallmat.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
END = 0
BLOCK_IDS = 1 << 20
# Bytes of text in a range of doc_id: a task encodes a stretch once, so long ranges meet fewer new ones a byte.
RANGE_BYTES = 32 << 20
MIN_COUNT = 24
# A round that shortens a block by less than this share is the last.
MIN_GAIN = 0.02

BLOCK_SCHEMA = (
    "part LONG, block LONG, doc_ids ARRAY<LONG>, ends ARRAY<LONG>, base LONG, rules BINARY, rule_lengths BINARY, symbols BINARY"
)


def _chosen(rank: np.ndarray) -> np.ndarray:
    """Places whose pair is replaced: of overlapping pairs the one with the higher rank; every other one of a run."""
    n = len(rank)
    new = np.ones(n, bool)
    new[1:] = rank[1:] != rank[:-1]
    run = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    even = (np.arange(n) - run) % 2 == 0
    before = np.zeros(n, rank.dtype)
    after = np.zeros(n, rank.dtype)
    before[1:], after[:-1] = rank[:-1], rank[1:]
    return (rank > 0) & even & (rank >= before) & (rank >= after)


def _sorted_pairs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of neighbours in ascending order, where each begins among the sorted places, and those places."""
    n = len(symbols) - 1
    bits, place_bits = int(symbols.max()).bit_length(), n.bit_length()
    key = symbols[:-1] << bits | symbols[1:]
    if 2 * bits + place_bits < 64:
        # pair and place in one number, so one plain sort gives both
        packed = np.sort(key << place_bits | np.arange(n))
        at, key = packed & ((1 << place_bits) - 1), packed >> place_bits
    else:
        at = np.argsort(key, kind="stable")
        key = key[at]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return np.stack([key[starts] >> bits, key[starts] & ((1 << bits) - 1)], 1), starts, at


def repair(ids: np.ndarray, base: int, min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rules is an n x 2 table, rule k stands for symbol base + k."""
    symbols = ids.astype(np.int64)
    rules = [np.zeros((0, 2), np.int64)]
    n_rules = 0
    while len(symbols) > 1:
        pairs, starts, places = _sorted_pairs(symbols)
        counts = np.diff(np.append(starts, len(places)))
        often = np.flatnonzero(counts >= min_count)
        if not len(often):
            break
        # rank 1 .. n by count, ties by first occurrence
        order = often[np.lexsort([places[starts[often]], counts[often]])]
        rank_of = np.zeros(len(pairs), np.int32)
        rank_of[order] = np.arange(1, len(order) + 1)
        rank = np.empty(len(places), np.int32)
        rank[places] = np.repeat(rank_of, counts)
        at = np.flatnonzero(_chosen(rank))
        used, index = np.unique(rank[at], return_inverse=True)
        rules.append(pairs[order[used - 1]])
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols[at] = base + n_rules + index
        n_rules += len(used)
        before = len(symbols)
        symbols = symbols[keep]
        if before - len(symbols) < min_gain * before:
            break
    return symbols, np.concatenate(rules)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to; rules refer only to earlier ones."""
    lengths = np.zeros(len(rules), np.int64)
    part = np.where(rules < base, 1, 0)
    left = np.flatnonzero((lengths == 0))
    while len(left):
        known = np.where(rules[left] < base, part[left], lengths[np.maximum(rules[left] - base, 0)])
        ready = (known > 0).all(1)
        lengths[left[ready]] = known[ready].sum(1)
        left = left[~ready]
    return lengths


def _expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    while True:
        compound = symbols >= base
        if not compound.any():
            return symbols
        at = np.cumsum(compound + 1) - (compound + 1)
        out = np.empty(len(symbols) + int(compound.sum()), np.int64)
        out[at[~compound]] = symbols[~compound]
        pairs = rules[symbols[compound] - base]
        out[at[compound]] = pairs[:, 0]
        out[at[compound] + 1] = pairs[:, 1]
        symbols = out


def decode(block: dict, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start .. stop of a block, expanding only the symbols that cover them."""
    base = block["base"]
    rules = np.frombuffer(block["rules"], "<u4").astype(np.int64).reshape(-1, 2)
    lengths = np.frombuffer(block["rule_lengths"], "<u4").astype(np.int64)
    symbols = np.frombuffer(block["symbols"], "<u4").astype(np.int64)
    size = np.ones(len(symbols), np.int64)
    size[symbols >= base] = lengths[symbols[symbols >= base] - base]
    ends = np.cumsum(size)
    stop = int(ends[-1]) if stop is None and len(ends) else (stop or 0)
    first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
    skipped = int(ends[first - 1]) if first else 0
    some = symbols[first : last + 1]
    if len(some) < len(rules):
        return _expand(some, rules, base)[start - skipped : stop - skipped]
    # every rule is expanded once, then gathered
    flat = _expand(base + np.arange(len(rules)), rules, base)
    compound = some >= base
    used = some[compound] - base
    counts = lengths[used]
    begin = (np.cumsum(lengths) - lengths)[used] - (np.cumsum(counts) - counts)
    inside = np.repeat(compound, size[first : last + 1])
    out = np.empty(len(inside), np.int64)
    out[~inside] = some[~compound]
    out[inside] = flat[np.arange(int(counts.sum())) + np.repeat(begin, counts)]
    return out[start - skipped : stop - skipped]


def _block_batches(batches: Iterator, path: str, spaces: bool, end: int, block_ids: int) -> Iterator:
    encoder = Encoder(path, spaces)
    base = encoder.tokenizer.get_vocab_size()
    part = TaskContext.get().partitionId()
    number = 0
    held: list[np.ndarray] = []
    docs: list[int] = []
    counts: list[int] = []

    def flush():
        nonlocal number
        ids = np.concatenate(held)
        symbols, rules = repair(ids, base)
        row = {
            "part": part,
            "block": number,
            "doc_ids": list(docs),
            "ends": np.cumsum(counts).tolist(),
            "base": base,
            "rules": rules.astype("<u4").tobytes(),
            "rule_lengths": rule_lengths(rules, base).astype("<u4").tobytes(),
            "symbols": symbols.astype("<u4").tobytes(),
        }
        number += 1
        for x in (held, docs, counts):
            x.clear()
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    for batch in batches:
        for rows in slices(batch, limit=TOKEN_SLICE):
            ids, n = with_end(*encoder.encode(rows.column("text")), end)
            ids_of = rows.column("doc_id").to_numpy()
            bounds = np.concatenate([[0], np.cumsum(n)])
            begin = 0
            while begin < len(n):
                room = max(1, block_ids - sum(counts))
                stop = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + room, side="right")) - 1)
                held.append(ids[bounds[begin] : bounds[stop]])
                docs.extend(ids_of[begin:stop].tolist())
                counts.extend(n[begin:stop].tolist())
                begin = stop
                if sum(counts) >= block_ids:
                    yield flush()
    if docs:
        yield flush()


def write_store(docs: DataFrame, target: str, path: str | None = None, spaces: bool = True, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts and write them, in ascending doc_id order, to the Parquet folder `target`."""
    path = path or tokenizer_path(TOKENIZER)
    texts = texts_of(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(-(-size // RANGE_BYTES), docs.sparkSession.sparkContext.defaultParallelism)
    (
        texts.repartitionByRange(ranges, F.col("doc_id"))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(lambda b: _block_batches(b, path, spaces, end, block_ids), BLOCK_SCHEMA)
        .write.parquet(target)
    )


def _document_batches(batches: Iterator) -> Iterator:
    for batch in batches:
        for i in range(batch.num_rows):
            block = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            ids = decode(block).astype("<u4")
            bounds = np.concatenate([[0], np.array(block["ends"], np.int64)])
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block["doc_ids"], pa.int64()),
                    pa.array(block["base_start"] + bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    pa.array([crc(ids[a:b]) for a, b in spans], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_store(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, decoded from the files."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(target)
    sizes = cut_lineage(blocks.select("part", "block", F.element_at("ends", -1).alias("n")))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # one row per range of ids: its first place in the whole store
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        sizes.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(starts, "part")
        .select("part", "block", (F.col("first") + F.col("within")).cast("long").alias("base_start"))
    )
    return (
        blocks.join(F.broadcast(places) if sizes.count() <= 100_000 else places, ["part", "block"])
        .mapInArrow(_document_batches, "doc_id LONG, start LONG, n_tokens LONG, ids_crc32 LONG")
    )


@query("op3_token_store")
def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), target)
    return read_store(spark, target)
