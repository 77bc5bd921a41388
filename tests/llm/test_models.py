"""Classifiers and the language model: held-out quality, base score, and edge cases."""

import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from plain_texts import words_of

from tallmat.llm import language_model, ranking, seating, toxicity
from tallmat.llm.catalog import QUERIES
from tallmat.llm.learning import labelled_sample

MORE = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(1)
    terms = [("idiot", True), ("scum", True), ("worthless", True), ("réeux", False), ("abab", False), ("abba", True)]
    lexicon = toxicity.Lexicon(terms)
    words = ["".join(rng.choice(list("abidotscuméreux"), rng.integers(1, 9))) for _ in range(800)]
    words += ["idiot", "idiott", "idi0t", "iddiott", "wortless", "wrthles", "worthlessness", "réeuxtion", "reeuxx", "réux", "abab", "ababxyz", "x" * 40, ""]
    edits, term = lexicon.match(words)
    for w, e, t in zip(words, edits.tolist(), term.tolist()):
        options = []
        for text, whole in terms:
            limit = toxicity.edits_allowed(len(text))
            d = distance(w, text) if whole else min(distance(w[:k], text) for k in range(len(w) + 1))
            options.append(d if d <= limit else 9)
        assert e == min(options), w
        assert e == 9 or options[t] == e


def outcome(spark, name, label):
    found = {r.doc_id: r for r in QUERIES[name](spark, MORE).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{MORE}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in found.values())
    held = [(found[i], y) for i, y in labels.items() if found[i].held_out]
    return found, held


def test_toxicity(spark):
    found, held = outcome(spark, "op2_toxicity", "toxic")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for i, r in found.items())
    toxic = [r.predicted for r, y in held if y]
    clean = [r.predicted for r, y in held if not y]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_quality_classifier(spark):
    found, held = outcome(spark, "op8_quality_classifier", "quality")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in found.items())
    right = [r.predicted == y for r, y in held]
    assert sum(right) >= 0.93 * len(right)


def test_ranking_prefers_the_better():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.0] > -1).astype(int)
    model = ranking.fit(x, y)
    score = model.score(x)
    assert ((score >= 0.3) == (y == 1)).mean() > 0.97
    assert np.isfinite(ranking.fit(x, np.ones(400, int)).score(x)).all()


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (ranking, "quality")])
def test_classifiers_on_odd_tables(spark, odd, empty, module, label):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame(
        [(505, 1), (506, 0), (516, 0), (None, 1), (507, None), (505, 0)], f"doc_id LONG, {label} INT"
    )
    for docs, rows in ((odd, labels), (odd, labels.limit(0)), (empty, labels)):
        lowered = docs.withColumn("text", F.lower("text"))
        model = module.learn(labelled_sample(lowered, rows, label, 3, 7, 100))
        scores = module.score(docs, model).collect()
        assert len(scores) == docs.where("doc_id IS NOT NULL").count()
        assert all(0 <= r.score <= 1 for r in scores)


def test_ranking_learns_from_all_labelled_rows(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    n = 16_000
    quality = (rng.random(n) < 0.6).astype(int)
    texts = [
        " ".join("".join(rng.choice(list("abcdefgh"), k)) for k in rng.integers(1, 5 + 3 * q, 8 + 4 * q)) for q in quality.tolist()
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id LONG, text STRING")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame(list(enumerate(quality.tolist())), "doc_id LONG, quality INT")
    # labels without a document are of no account
    labels.union(labels.selectExpr("doc_id + 1000000", "quality")).write.parquet(f"{tmp_path}/labels.parquet")
    # the threshold is the quantile of all training rows, so as many of them are rejected as are bad
    found = [r for r in QUERIES["op8_quality_classifier"](spark, str(tmp_path)).collect() if not r.held_out]
    assert len(found) > 12_000
    assert sum(r.predicted == 0 for r in found) == sum(quality[r.doc_id] == 0 for r in found)
    # one group is the same as a fit in memory
    monkeypatch.setattr(ranking, "GROUP", 1000)
    rows = ranking.measured(docs.where("doc_id < 600")).join(labels.withColumnRenamed("quality", "y"), "doc_id")
    x = ranking.features(pa.array(texts[:600]))
    model, mean = ranking.learn_measured(rows), x.mean(0)
    assert np.allclose(model.mean, mean) and np.allclose(model.deviation, np.where(x.std(0) > 1e-12, x.std(0), 1))
    # rows of a group are in the order of their hashes, so pairs and weights differ somewhat
    assert np.corrcoef(model.rank(x), ranking.fit(x, quality[:600]).rank(x))[0, 1] > 0.95


@pytest.mark.parametrize("group", [4, 32, 1000])
def test_every_row_is_in_a_pair(spark, group, monkeypatch):
    monkeypatch.setattr(ranking, "GROUP", group)
    monkeypatch.setattr(ranking, "NUMBERED", 20)
    # a class of three rows among 100, copies of an id, and a label that is of no class
    rows = [(i, int(i < 3), np.array([float(i)]).tobytes()) for i in range(100)] + [(7, 0, np.array([7.5]).tobytes()), (200, 5, np.array([9.0]).tobytes())]
    groups = ranking._dealt(spark.createDataFrame(rows, "doc_id LONG, y INT, x BINARY"), np.zeros(1), np.ones(1)).collect()
    assert len(groups) == math.ceil(100 / group) and all(g.good and g.bad for g in groups)
    bad = sorted(v for g in groups for v in np.frombuffer(bytes(g.bad)))
    assert bad == sorted([float(i) for i in range(3, 100)] + [7.5])
    assert {v for g in groups for v in np.frombuffer(bytes(g.good))} == {0.0, 1.0, 2.0}
    for g in groups:
        left, right = np.frombuffer(bytes(g.good)).reshape(-1, 1), np.frombuffer(bytes(g.bad)).reshape(-1, 1)
        made = ranking._differences(left, right)
        assert len(made) == max(20 * len(left), len(right))
        assert set((left[:, None] - right).ravel()) >= set(made.ravel())


def test_order_statistic(spark, monkeypatch):
    from tallmat.llm import learning

    monkeypatch.setattr(learning, "BINS", 4)
    values = [0.0, -1.5, 3.25, 3.25, 3.25, 1e-9, 2e-9, 7.0, 1e6]
    rows = spark.createDataFrame([(v,) for v in values], "z DOUBLE")
    assert [learning.order_statistic(rows, "z", k) for k in range(9)] == sorted(values)


def base_by_hand(rows):
    docs = [(i, words_of(t, lower=True) + [None]) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, ws in docs if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(
        (i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))
        for i, ws in docs
    )


def test_language_model(sample, sample_rows, monkeypatch):
    for tokens, size in ((4_000_000, 32 << 20), (3000, 40_000)):
        monkeypatch.setattr(language_model, "CHUNK_TOKENS", tokens)
        monkeypatch.setattr(language_model, "BUCKET_BYTES", size)
        rows = language_model.scored(sample).collect()
        got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
        assert got == base_by_hand(sample_rows)
        for part in (True, False):
            assert sum(r.score for r in rows if r.held_out == part) > sum(r.base_score for r in rows if r.held_out == part)
        assert all(r.score < 0 for r in rows)


def test_language_model_odd_tables(odd, empty):
    assert language_model.scored(empty).count() == 0
    assert language_model.scored(odd).count() == odd.where("doc_id IS NOT NULL").count()
    held = odd.where("doc_id IN (501, 513)").limit(1)
    row = language_model.scored(odd.where("doc_id = 500")).first()
    assert row.n_tokens == 1 and math.isfinite(row.score)
    assert held.count() == 1


@pytest.mark.parametrize("d", [0.1, 0.6, 0.8, 0.95])
def test_stirling_numbers_equal_their_recursion(d):
    exact = seating.stirling_table(900, d)
    for c in (65, 900):
        t = np.arange(1, c + 1)
        error = np.diff(seating.log_stirling(np.full(c, c), t, d)) - np.diff(exact[c, 1 : c + 1])
        inside = t[1:] <= max(c**d, 8)
        assert np.abs(error[inside]).max() < 1e-6
        assert np.abs(error).max() < 0.4 and np.median(np.abs(error[~inside])) < 0.05


def exact_tables(c, p, others, d):
    weight = seating.stirling_table(c, d)[c, 1:] + np.cumsum(np.log(p * (others + d * np.arange(c))))
    mass = np.exp(weight - weight.max())
    return mass / mass.sum()


@pytest.mark.parametrize("c, p, others, d", [(2, 0.3, 3.0, 0.6), (40, 0.05, 20.0, 0.8), (300, 0.01, 200.0, 0.7), (300, 0.2, 90.0, 0.8)])
def test_table_counts_follow_the_exact_posterior(c, p, others, d):
    draw = np.random.default_rng(0)
    n = 6000
    t = np.zeros(n, np.int64)
    for _ in range(4 if c > seating.EXACT else 1):
        t = seating.draw_tables(t, np.full(n, c), np.full(n, p), np.full(n, others), d, draw)
    assert (t >= 1).all() and (t <= c).all()
    want = exact_tables(c, p, others, d)
    got = np.bincount(t, minlength=c + 1)[1:] / n
    assert np.abs(np.cumsum(got) - np.cumsum(want)).max() < 0.03


def partitions(n):
    """All seatings of n customers, as lists of table sizes."""
    if n == 0:
        yield []
        return
    for sizes in partitions(n - 1):
        yield sizes + [1]
        for k in range(len(sizes)):
            yield sizes[:k] + [sizes[k] + 1] + sizes[k + 1 :]


def test_table_counts_equal_all_seatings_weighed():
    """Every seating of 7 customers weighed by the restaurant's own rule."""
    c, p, others, d = 7, 0.2, 6.0, 0.5
    weight = np.zeros(c + 1)
    for sizes in partitions(c):
        one = math.prod(p * (others + d * k) for k in range(len(sizes)))
        weight[len(sizes)] += one * math.prod(i - d for s in sizes for i in range(1, s))
    want = weight[1:] / weight.sum()
    assert exact_tables(c, p, others, d) == pytest.approx(want.tolist())
    n = 20_000
    drawn = seating.draw_tables(np.zeros(n, np.int64), np.full(n, c), np.full(n, p), np.full(n, others), d, np.random.default_rng(3))
    assert np.abs(np.bincount(drawn, minlength=c + 1)[1:] / n - want).max() < 0.015


def test_large_counts_are_seated_whole():
    """A popular word of a large context gets thousands of tables, not one per Gibbs move."""
    draw = np.random.default_rng(0)
    t = np.zeros(50, np.int64)
    for _ in range(3):
        t = seating.draw_tables(t, np.full(50, 100_000), np.full(50, 0.05), np.full(50, 40_000.0), 0.8, draw)
    assert (t > 500).all() and (t < 100_000**0.8 * 2).all()


def test_probabilities_of_a_context_sum_to_one():
    """Known words share what the unknown event leaves."""
    tokens = np.array([3, 5, 3, 9, 5, 3, 3, 9], np.uint64)
    contexts = np.array([1, 1, 1, 1, 2, 2, 2, 1])
    rows = list(language_model._chunk_rows(0, tokens, contexts, np.ones(8), [7], np.array([8]), 1))
    group = pa.Table.from_batches(rows).filter(pa.array([False, True]))
    bucket = language_model.Bucket(group)
    totals = language_model._first_totals(bucket, 1)
    for _ in range(3):
        bucket.sweep(totals)
    totals.tables = np.bincount(bucket.context, bucket.tables, language_model.CONTEXTS)
    totals.parent_customers, totals.parent_tables = bucket.parent_customers.sum(), bucket.parent_tables.sum()
    parent = totals.parent(bucket.parent_customers, bucket.parent_tables, totals.base())
    unknown = totals.parent(np.zeros(1), np.zeros(1), totals.unknown)[0]
    assert parent.sum() + unknown == pytest.approx(1)
    total = 0.0
    for w in range(3):
        here = (bucket.word == w) & (bucket.context == 1)
        seated = (bucket.customers[here] - totals.discount * bucket.tables[here]).sum()
        fresh = language_model.STRENGTH + totals.discount * totals.tables[1]
        total += (seated + fresh * parent[w]) / (language_model.STRENGTH + totals.customers[1])
    fresh = language_model.STRENGTH + totals.discount * totals.tables[1]
    assert total + fresh * unknown / (language_model.STRENGTH + totals.customers[1]) == pytest.approx(1)


def test_every_word_before_is_a_context_of_its_own(spark, monkeypatch):
    """x is always followed by y, whichever other word shares the low bits of its hash."""
    from tallmat.llm.words import Words

    names = [f"w{i}" for i in range(3000)]
    low = Words(pa.array([" ".join(names)]), lower=True).hashes() & np.uint64(0xFFFF)
    first = {}
    a, b = next((names[first[h]], names[i]) for i, h in enumerate(low.tolist()) if first.setdefault(h, i) != i)
    assert a != b
    rows = [(i, f"{a} after" if i % 2 else f"{b} other") for i in range(400)]
    for buckets in (1, 400):
        monkeypatch.setattr(language_model, "BUCKET_BYTES", 5000 // buckets)
        monkeypatch.setattr(language_model, "CHUNK_TOKENS", 200)
        docs = spark.createDataFrame(rows + [(1000, f"{a} other"), (1001, f"{a} after")], "doc_id LONG, text STRING").repartition(3)
        score = {r.doc_id: r.score for r in language_model.scored(docs).collect()}
        # half of the texts begin with each word, and the rest is certain
        assert score[1001] == pytest.approx(math.log10(0.5), abs=0.05)
        assert score[1000] < score[1001] - 1


def test_totals_of_contexts_equal_plain_sums():
    rng = np.random.default_rng(2)
    n, buckets = 5000, 7
    tokens = rng.integers(1, 1 << 62, 300).astype(np.uint64)[rng.zipf(1.5, n) % 300] * np.uint64(3)
    contexts = np.append(np.uint64(5), tokens[:-1])
    # half of the words are in the book
    book = SimpleNamespace(value=np.unique(tokens)[::2])
    halves = [list(language_model._chunk_rows(i, tokens[i::2], contexts[i::2], np.ones(n // 2), [], np.array([n // 2]), buckets, book.value)) for i in (0, 1)]
    rows = sorted((b for h in halves for b in h if b.column("bucket")[0].as_py() >= 0), key=lambda b: b.column("bucket")[0].as_py())
    sent = list(language_model._total_batches(iter(rows), buckets, book))
    dealt = sorted((b for b in sent if b.column("place")[0].as_py() >= 0), key=lambda b: b.column("place")[0].as_py())
    back = [r for b in language_model._place_batches(iter(dealt)) for r in b.to_pylist()]
    total = Counter(contexts.tolist())
    for group in language_model._groups(iter(rows), "bucket"):
        bucket = language_model.Bucket(group, book.value)
        mine = sorted((r for r in back if r["bucket"] == group.column("bucket")[0].as_py()), key=lambda r: -r["chunk"])
        got = np.concatenate([language_model._unpacked(r["a"], "u8") for r in mine])
        assert got.tolist() == [total[c] for c in bucket.contexts.tolist()]


def test_memory_of_chunks_and_buckets_follows_their_pairs():
    """A chunk takes at most 45 bytes a token beside its arguments, a bucket 90 bytes a row of pairs."""
    import tracemalloc

    rng = np.random.default_rng(4)
    n = 1_000_000
    words = rng.integers(1, 1 << 62, 200_000).astype(np.uint64)
    tokens = words[rng.zipf(1.2, n) % len(words)]
    contexts, train, lengths = np.append(np.uint64(5), tokens[:-1]), np.ones(n, bool), np.array([n])
    tracemalloc.start()
    try:
        rows = list(language_model._chunk_rows(0, tokens, contexts, train, [7], lengths, 1))
        assert tracemalloc.get_traced_memory()[1] < 45 * n
        group = pa.Table.from_batches(rows[1:])
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        bucket = language_model._burnt_in(group, 1, language_model._NO_BOOK)
        assert tracemalloc.get_traced_memory()[1] - before < 90 * len(bucket.pair_of)
    finally:
        tracemalloc.stop()
    assert bucket.customers.sum() == n and len(bucket.word) == len(set(zip(tokens.tolist(), contexts.tolist())))


def test_packed_round_trip():
    for x in (np.array([], np.uint32), np.arange(1000, dtype=np.uint64) ** 3, np.array([1.5, -2], np.float32)):
        back = language_model._unpacked(language_model._packed(x), x.dtype.str[1:])
        assert back.tolist() == x.tolist()


def test_features_of_odd_texts():
    texts = pa.array([None, "", " \n", "x", "É" * 5000, "a\x00b"])
    assert np.isfinite(ranking.features(texts)).all()
    assert np.isfinite(toxicity.features(texts, toxicity.Lexicon([("idiot", True)]))).all()
