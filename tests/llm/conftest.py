import random

import pytest
from plain_texts import DATA, sentence


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): NULL, empty, blank, long, repeated, tied and edited texts, and shared passages."""
    rng = random.Random(5)
    base = sentence(rng, 140)
    passage = sentence(rng, 60)
    long = sentence(rng, 9000)
    edited = base.split()
    edited[70] = "edited"
    rows = [
        (500, None), (501, ""), (502, " \t\n "), (503, "one"), (504, "one two"), (505, base), (506, base), (507, base),
        (508, " ".join(edited)), (509, sentence(rng, 30) + " " + passage + "\n" + sentence(rng, 20)),
        (510, passage + " " + sentence(rng, 30)), (511, long), (512, "x" * 3000), (513, "é😀 Straße ß  q " * 30),
        (514, ("a b c d e " * 40)), (516, "mail a.b@c.org +1 (017) 555-7713 or 10.0.0.1, 4111 1111 1111 1111."),
        (517, base.upper()), (505, base), (None, base), (518, "  two  spaces \n\n and  lines \x0b here ")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows as documents, with extra columns whose names the operators use themselves."""
    rows = [(i, t, None if k % 3 else "en", "src0", len(t or ""), k, "x", float(k), [k]) for k, (i, t) in enumerate(odd_rows)]
    schema = (
        "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, seed INT, words STRING, score DOUBLE, sig ARRAY<INT>"
    )
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")


@pytest.fixture(scope="session")
def sample_rows(spark, odd_rows):
    """Given documents together with the odd ones that have an id."""
    given = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in given] + [r for r in odd_rows if r[0] is not None]


@pytest.fixture(scope="session")
def sample(spark, sample_rows):
    return spark.createDataFrame(sample_rows, "doc_id LONG, text STRING").repartition(4)
