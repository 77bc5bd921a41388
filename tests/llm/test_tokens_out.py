"""Token store and packing: exact round trips and gapless sequences."""

import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from tallmat.llm import packing, token_store
from tallmat.llm.tokens import tokenizer_path


def encoded(rows, name, end):
    plain = Tokenizer.from_file(tokenizer_path(name))
    plain.encode_special_tokens = True
    return [(i, plain.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    for n, v in ((0, 5), (1, 5), (2, 1), (51, 1), (4000, 3), (20000, 60)):
        ids = rng.integers(0, v, n).astype(np.uint32)
        symbols, rules = token_store.repair(ids, v, 3, 0.0)
        block = {
            "base": v,
            "rules": rules.astype("<u4").tobytes(),
            "rule_lengths": token_store.rule_lengths(rules, v).astype("<u4").tobytes(),
            "symbols": symbols.astype("<u4").tobytes(),
        }
        assert token_store.decode(block).tolist() == ids.tolist()
        assert len(symbols) <= n
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert token_store.decode(block, a, b).tolist() == ids[a:b].tolist()
        if n > 1000:
            assert len(symbols) < n
            pairs = Counter(zip(symbols[:-1].tolist(), symbols[1:].tolist()))
            assert max(pairs.values()) < n


def test_repair_of_large_symbols():
    """Pairs that don't fit one number with their place are sorted in another way, with the same result."""
    ids = np.random.default_rng(2).integers(0, 40, 5000).astype(np.uint32)
    small, rules = token_store.repair(ids, 1000, 3, 0.0)
    apart = np.uint32(1 << 25)
    large, shifted = token_store.repair(ids + apart, 1000 + int(apart), 3, 0.0)
    assert (small + int(apart)).tolist() == large.tolist()
    assert (rules + int(apart)).tolist() == shifted.tolist()


def test_token_store(sample, sample_rows, tmp_path):
    rows = sorted(dict(sample_rows).items())
    docs = sample.sparkSession.createDataFrame(rows, "doc_id LONG, text STRING").repartition(5)
    target = str(tmp_path / "store")
    token_store.write_store(docs, target, block_ids=5000)
    want, start = {}, 0
    for i, ids in encoded(rows, token_store.TOKENIZER, 0):
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_store(docs.sparkSession, target).collect()}
    assert got == want


def test_ranges_of_the_store_follow_the_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "RANGE_BYTES", 1000)
    docs = spark.createDataFrame([(i, "some words " * 20) for i in range(200)], "doc_id LONG, text STRING")
    token_store.write_store(docs, str(tmp_path / "store"))
    assert 40 <= spark.read.parquet(str(tmp_path / "store")).select("part").distinct().count() <= 44
    found = token_store.read_store(spark, str(tmp_path / "store")).orderBy("start").collect()
    assert [r.doc_id for r in found] == list(range(200))


def test_token_store_odd_tables(odd, empty, tmp_path):
    spark = odd.sparkSession
    token_store.write_store(empty, str(tmp_path / "a"))
    assert token_store.read_store(spark, str(tmp_path / "a")).count() == 0
    token_store.write_store(odd, str(tmp_path / "b"))
    found = token_store.read_store(spark, str(tmp_path / "b")).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(r.doc_id for r in odd.where("doc_id IS NOT NULL").collect())
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:]))


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def fewest(lengths, capacity):
    """A lower bound: pieces above half a sequence never share one, and the shorter ones need room beside them."""
    best = 0
    for least in range(capacity // 2 + 1):
        alone = sum(n > capacity - least for n in lengths)
        large = [n for n in lengths if capacity / 2 < n <= capacity - least]
        small = sum(n for n in lengths if least <= n <= capacity / 2)
        best = max(best, alone + len(large) + max(0, -(-(small - len(large) * capacity + sum(large)) // capacity)))
    return best


def test_packing(sample, sample_rows):
    for capacity in (4096, 300):
        rows = packing.pack(sample, capacity=capacity, with_ids=True).collect()
        want = Counter()
        for i, ids in encoded(sample_rows, packing.TOKENIZER, 1):
            for p in range(-(-len(ids) // capacity)):
                part = ids[p * capacity : (p + 1) * capacity]
                want[i, p, p * capacity, len(part), crc(part)] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
        used = check_sequences(rows, capacity)
        assert used <= fewest([r.length for r in rows], capacity) + 1


def test_packing_odd_tables(odd, empty):
    assert packing.pack(empty).count() == 0
    rows = packing.pack(odd).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()} - {None}
    check_sequences(rows, packing.CAPACITY)


def test_fullest_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(200):
        room = rng.randrange(1, 40)
        available = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))}
        sums = {0}
        for length, count in available.items():
            for _ in range(count):
                sums |= {s + length for s in sums if s + length <= room}
        chosen = packing.fullest(available, room)
        assert sum(n * m for n, m in chosen.items()) == max(sums)
        assert all(m <= available[n] for n, m in chosen.items())


def test_plan_uses_every_piece():
    rng = random.Random(4)
    counts = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(40)}
    used = Counter()
    for chosen, times in packing.plan(counts, 100):
        assert sum(n * m for n, m in chosen.items()) <= 100
        for n, m in chosen.items():
            used[n] += m * times
    assert used == Counter(counts)
