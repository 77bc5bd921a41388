"""Substring and near dedup, and graph components, against exhaustive versions."""

import hashlib
import random

import pyarrow as pa
import pytest
from plain_texts import sentence, words_of

from tallmat.llm import near_dedup
from tallmat.llm.graph import components
from tallmat.llm.near_dedup import near_duplicates
from tallmat.llm.substring_dedup import remove_repeats


def removed_by_hand(rows, window):
    first = {}
    for doc, text in rows:
        w = words_of(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [50, 7])
def test_substring_dedup(sample, sample_rows, window):
    rows = sample_rows + [(505, "other words under the same number " * 12)]
    docs = sample.sparkSession.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    found = remove_repeats(docs, window).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found)
    assert got == removed_by_hand(rows, window)
    for r in found:
        spans = list(zip(r.edges[0::2], r.edges[1::2]))
        assert sum(b - a for a, b in spans) == r.n_removed
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert (r.kept_text is None) == (r.n_removed == 0)


def test_substring_dedup_odd_tables(odd, empty):
    assert remove_repeats(empty).count() == 0
    assert remove_repeats(odd).count() == odd.where("doc_id IS NOT NULL").count()


def components_by_hand(rows, width=2):
    sets = {}
    for doc, text in rows:
        w = words_of(text, lower=True)
        shingles = [tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))] if w else []
        sets.setdefault(doc, []).append(frozenset(shingles))
    up = {d: d for d in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= 80 * len(x | y):
                        p, q = find(a), find(b)
                        up[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d), d == find(d)) for d in docs for s in sets[d])


def groups(rng):
    """Chains of edits (neighbours alike, ends not), stars, and texts near the limit."""
    rows = []
    for g in range(6):
        text = sentence(rng, 90, 5000).split()
        for k in range(25):
            rows.append((1000 + 100 * g + k, " ".join(text)))
            for _ in range(1 + g % 3):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
    for k in range(40):
        star = rows[0][1].split()
        star[2 * k % 90] = f"s{k}"
        rows.append((3000 + k, " ".join(star)))
    return rows


@pytest.mark.parametrize("small, leaf", [(64, 40), (4, 40), (4, 6)])
def test_near_dedup(sample, sample_rows, monkeypatch, small, leaf):
    """Small limits send groups through joins and through nodes cut into blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    rows = sample_rows[:120] + sample_rows[-20:] + groups(random.Random(3))
    docs = sample.sparkSession.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == components_by_hand(rows)


def test_five_word_shingles(sample, sample_rows):
    """Long texts with few edits, and texts of fewer words than a shingle, told apart by the order of their words."""
    rng = random.Random(4)
    rows = sample_rows[:60] + groups(rng)[:50] + [(9001, "a b c d"), (9002, "a  B c d"), (9003, "d c b a"), (9004, "a b c"), (9005, "a")]
    for k in range(12):
        words = sentence(random.Random(99), 300, 5000).split()
        for at in rng.sample(range(300), k):
            words[at] = f"x{at}"
        rows.append((4000 + k, " ".join(words)))
    docs = sample.sparkSession.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, 5).collect())
    assert got == components_by_hand(rows, 5)


def test_near_dedup_pairs_without_candidates_in_large_nodes(spark, monkeypatch):
    """Near duplicates of one large node that lie in different blocks, where no block has a candidate."""
    rng = random.Random(21)
    rows = [(k, sentence(rng, 120, 5000)) for k in range(5)]
    rows.append((5, rows[2][1] + " more"))
    leaves = spark.createDataFrame([(1 + (i > 2), i) for i in range(6)], "node LONG, id LONG")
    cut = spark.createDataFrame([(i, 0, 9, 1 + (i > 2)) for i in range(6)], "id LONG, pivot LONG, parent LONG, node LONG")
    monkeypatch.setattr(near_dedup, "_leaves", lambda sketches: (leaves, cut))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == components_by_hand(rows)


def test_exact_blocks(monkeypatch):
    """Two blocks in one task: forest of the exact edges, over several chunks of columns, empty and equal ids included."""
    monkeypatch.setattr(near_dedup, "_WIDTH", 7)
    rows = groups(random.Random(9))[::3] + [(7, ""), (7, None), (8, "one")]
    rows.sort(key=lambda r: r[0])
    batch = pa.RecordBatch.from_pydict({"task": [1] * len(rows), "id": [r[0] for r in rows], "root": [r[0] for r in rows], "text": [r[1] for r in rows]})
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for out in near_dedup._rest_batches(iter([batch])):
        for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist()):
            p, q = find(a), find(b)
            assert p != q
            up[max(p, q)] = min(p, q)
    assert {(i, find(i)) for i in up} == {(i, c) for i, _, c, _ in components_by_hand(rows)}


def test_tasks_hold_two_blocks(spark, monkeypatch):
    """A node of a template's pages, none confirmed with another: all pairs of like sizes meet, in bounded tasks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    n = 400
    cut = spark.createDataFrame([(5, i, 0) for i in range(n)], "parent LONG, id LONG, pivot LONG")
    labels = spark.createDataFrame([(i, 0) for i in range(50)], "id LONG, root LONG")
    sketches = spark.createDataFrame([(i, 100 + 100 * (i % 3 == 1) + 20 * (i % 3 == 2)) for i in range(n)], "id LONG, n LONG")
    tasks = {}
    for r in near_dedup._tasks(cut, labels, sketches).collect():
        tasks.setdefault(r.task, set()).add(r.id)
    assert max(map(len, tasks.values())) <= 4 * near_dedup.BLOCK
    met = {(p, q) for ids in tasks.values() for p in ids for q in ids}
    size = {i: 100 + 100 * (i % 3 == 1) + 20 * (i % 3 == 2) for i in range(n)}
    for p in range(n):
        for q in range(max(p + 1, 50), n):
            assert (p, q) in met or 100 * min(size[p], size[q]) < 80 * max(size[p], size[q])


def test_near_dedup_odd_tables(odd, empty):
    assert near_duplicates(empty).count() == 0
    found = {r.doc_id: r for r in near_duplicates(odd).collect()}
    assert found[500].n_shingles == found[501].n_shingles == found[502].n_shingles == 0
    assert found[503].n_shingles == 1 and found[503].kept
    assert {found[i].component_id for i in (505, 506, 507, 508, 517)} == {505}
    stays = near_dedup.deduplicated(odd)
    assert stays.columns == odd.columns
    assert sorted(r.doc_id for r in stays.where("doc_id IN (505, 506, 507, 508, 517)").collect()) == [505]
    assert stays.where("doc_id IS NULL").count() == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    got = {(r.id, r.root) for r in components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == {(i, find(i)) for i in up}
