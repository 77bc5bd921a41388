"""The pipeline's stages against plain Python, and all rows through the whole of it."""

import re

import corpus_pipeline
from plain_texts import DATA, words_of

import __spark_entry__ as driver
from tallmat.llm import near_dedup, quality_rules
from tallmat.llm.common import stored


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], DATA), name))
    raw, good, single, clean, private, packed = tables
    assert all(t.columns == columns for t in (good, single, clean, private))
    keeps = {r.doc_id for r in quality_rules.quality(raw).where("kept").collect()}
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert ids[1] == keeps
    assert ids[2] == {r.doc_id for r in near_dedup.near_duplicates(good, 5).where("kept").collect()}
    items = [words_of(r.text, True) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for r in single.collect():
        text = " " + " ".join(words_of(r.text, True)) + " "
        leaked = any(len(i) > 3 and " " + " ".join(i) + " " in text for i in items)
        assert not leaked or r.doc_id not in ids[3]
    assert len(ids[3]) >= 0.9 * len(ids[2])
    for r in private.collect():
        assert not re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", r.text) and r.n_chars == len(r.text)
    assert ids[4] == ids[3] == ids[5]
    assert packed.count() >= private.count()


def test_registered(spark):
    names = driver.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert corpus_pipeline.run(spark, DATA).count() > 0
