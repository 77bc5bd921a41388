"""Command line: `python -m tallmat JOB ...`, or the same file through spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tallmat import jobs
from tallmat.operators import pca, preprocess
from tallmat.sources import readers


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tallmat")
    sub = parser.add_subparsers(dest="job", required=True)

    p = sub.add_parser("pca", help="truncated PCA of the datasets of a manifest")
    p.add_argument("manifest")
    p.add_argument("k", type=int)
    p.add_argument("out")
    p.add_argument("--preprocess", choices=preprocess.METHODS, default="centerOverAllObservations")
    p.add_argument("--method", choices=pca.METHODS, default="exact")
    p.add_argument("--weights", help="lines row,weight")
    p.add_argument("--latitudes", help="lines row,latitude")
    p.add_argument("--seed", type=int, default=0)

    p = sub.add_parser("cx", help="leverage scores of a sparse matrix")
    p.add_argument("kind", choices=jobs.MATRIX_KINDS)
    p.add_argument("path")
    for name in ("rank", "slack", "iters"):
        p.add_argument(name, type=int)
    p.add_argument("out")
    for name in ("rows", "cols", "parts", "seed"):
        p.add_argument(f"--{name}", type=int, default=0)

    p = sub.add_parser("compact", help="lines column,row,value to a matrix over dense ids")
    p.add_argument("path")
    p.add_argument("out")

    p = sub.add_parser("nmf", help="near-separable non-negative factorization")
    for name in ("path", "column", "row_id"):
        p.add_argument(name)
    p.add_argument("r", type=int)
    p.add_argument("out")
    p.add_argument("--partitions", type=int)
    p.add_argument("--negatives", choices=preprocess.NEGATIVES, default="clamp_log")
    p.add_argument("--with-w", action="store_true")

    p = sub.add_parser("export", help="a saved PCA model as Matrix Market")
    p.add_argument("model")
    p.add_argument("out")

    p = sub.add_parser("gram-check", help="A'A times ones, from and to Matrix Market")
    p.add_argument("path")
    p.add_argument("out")
    return parser


def main(argv: list[str] | None = None) -> None:
    o = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("tallmat").getOrCreate()
    if o.job == "pca":
        weights = None
        if o.weights:
            weights = readers.read_row_weights(spark, o.weights)
        elif o.latitudes:
            weights = readers.read_latitude_weights(spark, o.latitudes)
        jobs.pca_job(spark, o.manifest, o.k, o.out, o.preprocess, o.method, weights, o.seed)
    elif o.job == "cx":
        jobs.cx_job(
            spark, o.kind, o.path, o.rank, o.slack, o.iters, o.out, o.rows, o.cols, o.parts, o.seed
        )
    elif o.job == "compact":
        jobs.compact_job(spark, o.path, o.out)
    elif o.job == "nmf":
        jobs.nmf_job(
            spark, o.path, o.column, o.row_id, o.r, o.out, o.partitions, o.negatives, o.with_w
        )
    elif o.job == "export":
        jobs.export_job(spark, o.model, o.out)
    else:
        jobs.gram_check_job(spark, o.path, o.out)


if __name__ == "__main__":
    main()
