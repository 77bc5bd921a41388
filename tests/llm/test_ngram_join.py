"""N-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from plain_texts import sentence, words_of
from pyspark.sql import functions as F

from tallmat.llm import ngram_join
from tallmat.llm.ngram_join import choose_matches, jaccard_components, required


def by_hand(rows, width, percent):
    sets = {}
    for doc, text in rows:
        w = words_of(text, lower=True)
        if doc is not None:
            grams = zip(*(w[i:] for i in range(width))) if len(w) >= width else [tuple(w)] if w else []
            sets.setdefault(doc, []).append(frozenset(grams))
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
                    both = len(x & y)
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        p, q = find(a), find(b)
                        up[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d)) for d in docs for s in sets[d])


def found(docs, width=4, percent=85):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, width, percent).collect())


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def families(rng):
    """Chains and stars of edits on both sides of the limit, a template that is filled in, and texts that extend others."""
    rows = []
    for g in range(8):
        text = sentence(rng, rng.choice([12, 60, 150]), 4000)
        for k in range(14):
            rows.append((1000 + 100 * g + k, text))
            text = edited(rng, text, 1 + g % 3)
    base = sentence(rng, 160, 4000)
    rows += [(3000 + k, edited(rng, base, rng.randrange(7))) for k in range(60)]
    template = sentence(rng, 120, 4000)
    rows += [(4000 + k, edited(rng, template, 6)) for k in range(60)]
    for k in range(20):
        text = sentence(rng, 100, 4000)
        rows += [(5000 + 2 * k, text), (5001 + 2 * k, text + " " + sentence(rng, 10 + k, 4000))]
    return rows


@pytest.mark.parametrize("seed, block", [(3, 2048), (4, 7)])
def test_against_all_pairs(sample, sample_rows, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = sample_rows[:120] + sample_rows[-20:] + families(random.Random(seed))
    rows += [(505, "another text under a number that is taken"), (509, rows[0][1]), (500, rows[0][1])]
    docs = sample.sparkSession.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    assert found(docs) == by_hand(rows, 4, 85)


def test_other_widths(spark):
    rows = families(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    assert found(docs, 2, 60) == by_hand(rows, 2, 60)


def test_prefixes_hold_all_similar_pairs():
    """min(l) shared shingles within the chosen prefixes, whatever l each set chose."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        r = np.sort(rng.choice(400, n, replace=False))
        s = np.unique(np.concatenate([rng.choice(r, max(1, n - int(rng.integers(0, 8))), replace=False), rng.integers(0, 400, 3)]))
        both = len(np.intersect1d(r, s))
        if 100 * both < 85 * (len(r) + len(s) - both):
            continue
        chosen = [int(rng.integers(1, required(len(x), 85) + 1)) for x in (r, s)]
        prefixes = [x[: len(x) - required(len(x), 85) + m] for x, m in zip((r, s), chosen)]
        assert len(np.intersect1d(*prefixes)) >= min(chosen)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(100):
        r, s = (np.unique(rng.integers(0, 900, int(rng.integers(1, 400)))).astype(np.uint64) for _ in range(2))
        found = ngram_join.parities(np.concatenate([r, s]), np.array([len(r), len(s)])).reshape(2, -1)
        bits = sum(int(x).bit_count() for x in found[0] ^ found[1])
        apart = len(np.setxor1d(r, s))
        assert bits <= apart and (apart - bits) % 2 == 0


def test_matches_follow_the_cost():
    rare, common = np.full(90, 2), np.full(90, 1000)
    assert choose_matches(common, 100, 10, 85) > 1
    assert 1 <= choose_matches(rare, 100, 10, 85) <= required(100, 85)
    assert choose_matches(np.zeros(0, np.int64), 1, 0, 85) == 1


def test_texts_of_a_template_are_no_candidates(spark):
    """A group below the limit that shares most of its text gives no pairs: rows stay linear in its size."""
    rng = random.Random(6)
    template = sentence(rng, 150, 4000).split()
    rows = []
    for k in range(300):
        words = list(template)
        for i in range(5, 150, 21):
            words[i] = f"own{k}x{i}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id LONG, text STRING")
    texts = docs.selectExpr("doc_id AS id", "CAST(147 AS LONG) AS n", "text", f"array_repeat(0L, {ngram_join.PARITY}) AS parity")
    mixed = ngram_join._mixed(ngram_join._labelled(ngram_join.postings(texts, 4, 85), None)).join(texts.select("id", "parity"), "id")
    assert ngram_join.candidates(mixed, 85).count() == 0
    assert found(docs) == by_hand(rows, 4, 85)


def test_odd_tables(odd, odd_rows, empty):
    assert found(empty) == []
    assert found(odd) == by_hand(odd_rows, 4, 85)


def test_few_shared_shingles_do_not_survive(spark):
    """Sets that share six shingles of their prefixes by chance are no near copies; sets that share most of them may be."""
    n = 100
    length = int(n - required(n, 85) + ngram_join._first_matches(n, 85))

    def prefix(i, shared, group):
        return [group * 1000 + k for k in range(shared)] + [i * 1_000_000 + k for k in range(length - shared)]

    rows = [(1, 1, n, prefix(1, 6, 1)), (2, 2, n, prefix(2, 6, 1)), (3, 3, n, prefix(3, 20, 2)), (4, 4, n, prefix(4, 20, 2))]
    classes = spark.createDataFrame(rows, "id LONG, doc_id LONG, n LONG, prefix ARRAY<LONG>")
    assert sorted(r.id for r in ngram_join.survivors(classes, 85).collect()) == [3, 4]


def test_postings_are_dealt_once(spark):
    rows = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (3, 7)], "id LONG, h LONG").withColumn("root", F.col("id"))
    mixed = ngram_join._mixed(rows)
    assert sorted((r.id, r.h, r.size) for r in mixed.collect()) == [(1, 7, 3), (2, 7, 3), (3, 7, 3)]
    plan = mixed._jdf.queryExecution().sparkPlan().toString() + mixed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
