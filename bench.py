"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from tallmat.plans.catalog import QUERIES
from tallmat.session import local_session

HEADLINE = [
    "src1_coo_csv",
    "src3_compact_ids",
    "src6_matrix_market_sparse",
    "elt13_clamp_log",
    "agg8_frobenius",
    "agg10_row_mean_std",
    "pre6_standardize",
    "prd2_gram_times",
    "prd2_gram_times_joined",
    "prd8_gram",
    "fac1_tsqr_gram",
    "fac2_thin_qr_orthonormal",
    "fac3_exact_right_vectors",
    "fac3_krylov_right_vectors",
    "fac5_randomized_singular_values",
    "fac7_pca_scores",
    "fac11_cx_job",
    "fac14_nnls_rows",
    "fac17_nmf_relative_error",
    "fac18_least_squares",
    "snk1_save_model",
    "cx4_relative_error",
]
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # start the Python workers before the clock does
    QUERIES["fac1_tsqr_norms"](spark, sf_dir).collect()

    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        spark.catalog.clearCache()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": f"headline queries, total of the best of {RUNS} runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
