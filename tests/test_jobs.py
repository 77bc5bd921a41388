"""The command line jobs, end to end on small files."""

import numpy as np
import pytest
from plain_matrices import dense

from tallmat import PcaModel
from tallmat.__main__ import main
from tallmat.operators.cx import CxScores
from tallmat.operators.nmf import load_nmf
from tallmat.sources import readers, sinks

RNG = np.random.default_rng(5)


@pytest.fixture
def dataset(make, tmp_path):
    x = RNG.normal(size=(10, 4))
    make(x, 1).df.orderBy("row_id").coalesce(1).write.parquet(str(tmp_path / "data"))
    return x, str(tmp_path / "data")


def manifest(tmp_path, data):
    (tmp_path / "manifest").write_text(f"{data} v 3\n")
    return str(tmp_path / "manifest")


def test_pca_and_export(spark, dataset, tmp_path):
    x, data = dataset
    # fixed values of the 10-row smoke input
    lat = np.array([0, 89, 72, 0, 0, 0, -86.2, 0, 0, 0])
    (tmp_path / "lat.csv").write_text("".join(f"{i},{v}\n" for i, v in enumerate(lat)))
    out = str(tmp_path / "model")
    main(
        ["pca", manifest(tmp_path, data), "3", out, "--preprocess",
         "cosLat+centerOverAllObservations", "--latitudes", str(tmp_path / "lat.csv")]
    )
    want = (x - x.mean(1, keepdims=True)) * np.sqrt(np.cos(np.radians(lat)))[:, None]
    model = PcaModel.load(spark, out)
    assert np.allclose(model.singular_values(), np.linalg.svd(want, compute_uv=False)[:3])
    main(["export", out, str(tmp_path / "mm")])
    v = readers.read_matrix_market_checked(spark, str(tmp_path / "mm" / "rowEOFs"))
    assert np.allclose(dense(v.coo(), (4, 3)), model.v.to_numpy())


def test_both_methods_save_twice(spark, dataset, tmp_path):
    x, data = dataset
    main(["pca", manifest(tmp_path, data), "2", str(tmp_path / "m-"), "--method", "both"])
    values = [PcaModel.load(spark, f"{tmp_path}/m-{s}").singular_values() for s in ("exact", "inexact")]
    assert np.allclose(*values)


def test_compact_then_cx(spark, tmp_path):
    x = RNG.normal(size=(8, 5)) * (RNG.random((8, 5)) < 0.7)
    lines = [f"{j * 10 + 3},{i * 7},{float(x[i, j])!r}\n" for i, j in zip(*np.nonzero(x))]
    (tmp_path / "coo.csv").write_text("".join(lines))
    main(["compact", str(tmp_path / "coo.csv"), str(tmp_path / "m")])
    names = [r.value for r in spark.read.text(f"{tmp_path}/m/coltab.txt").collect()]
    assert names == [str(j * 10 + 3) for j in range(5)]
    main(["cx", "df", str(tmp_path / "m"), "2", "3", "2", str(tmp_path / "cx"), "--parts", "2"])
    scores = CxScores.load(spark, str(tmp_path / "cx"))
    _, s, vt = np.linalg.svd(x)
    assert [r.s for r in scores.s.orderBy("comp").collect()] == pytest.approx(list(s[:2]))
    got = [r.p for r in scores.col_lev.orderBy("col_id").collect()]
    assert got == pytest.approx(list((vt[:2] ** 2).sum(0) / 2))


def test_cx_of_a_stated_shape(spark, tmp_path):
    (tmp_path / "coo.csv").write_text("0,0,3\n2,4,1\n")
    main(["cx", "csv", str(tmp_path / "coo.csv"), "2", "1", "2", str(tmp_path / "cx"),
          "--rows", "6", "--cols", "4"])
    scores = CxScores.load(spark, str(tmp_path / "cx"))
    rows = [r.p for r in scores.row_lev.orderBy("row_id").collect()]
    assert rows == pytest.approx([0.5, 0, 0, 0, 0.5, 0])
    assert scores.col_lev.count() == 4


def test_nmf(spark, dataset, tmp_path):
    x, data = dataset
    main(["nmf", data, "v", "row_id", "2", str(tmp_path / "nmf"), "--with-w"])
    parts = load_nmf(spark, str(tmp_path / "nmf"))
    picks = [r.col_id for r in parts["columns"].orderBy("rank_pos").collect()]
    w = np.array([r.v for r in parts["w"].orderBy("row_id").collect()])
    assert np.allclose(w, np.where(x < 0, 0, np.log1p(np.maximum(x, 0)))[:, picks])


def test_gram_check(spark, make_coo, tmp_path):
    x = RNG.integers(0, 3, size=(6, 4)).astype(float)
    sinks.write_matrix_market(make_coo(x).df, 6, 4, str(tmp_path / "a"))
    main(["gram-check", str(tmp_path / "a"), str(tmp_path / "b")])
    got = readers.read_matrix_market_checked(spark, str(tmp_path / "b"))
    assert np.array_equal(dense(got.coo(), (4, 32)), x.T @ x @ np.ones((4, 32)))
