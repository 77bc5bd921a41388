"""Queries whose tasks get objects of this library, on workers that can't import it."""

import subprocess
import sys
from pathlib import Path

from plain_texts import DATA

REPO = Path(__file__).resolve().parents[2]
RUN = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from tallmat.llm.catalog import QUERIES
from tallmat.session import local_session

spark = local_session(cpus=4, memory="4g")


def known(batches):
    import importlib.util

    for batch in batches:
        assert importlib.util.find_spec("tallmat") is None
        yield batch


assert spark.range(3).mapInArrow(known, "id LONG").count() == 3
for name in ("op2_toxicity", "op4_language_model", "op8_quality_classifier", "op10_benchmark_decontamination"):
    assert QUERIES[name](spark, {DATA!r}).count() > 0
print("done")
"""


def test_workers_need_no_package(tmp_path):
    done = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("done"), done.stderr[-3000:]
