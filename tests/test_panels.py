import numpy as np
import pytest
from plain_matrices import dense

from tallmat.operators import panels, products, tsqr
from tallmat.operators.blocked import BlockedMatrix

RNG = np.random.default_rng(23)


def upper(r, n):
    return dense(r, (n, r.n_cols))


@pytest.mark.parametrize("width", [4, 5, 50])
def test_panels_give_the_factor(make, width):
    x = RNG.normal(size=(40, 13)) * np.logspace(-4, 4, 13)
    found = panels.panel_qr(make(x), width)
    r = upper(found.r, 13)
    want = np.linalg.qr(x, mode="r")
    want *= np.where(np.diag(want) < 0, -1, 1)[:, None]
    assert np.allclose(r / np.linalg.norm(x, axis=0), want / np.linalg.norm(x, axis=0), atol=1e-12)
    assert (np.tril(r, -1) == 0).all() and found.dependent == 0
    assert np.allclose(found.col_l1, np.abs(x).sum(axis=0)) and found.n_rows == 40


@pytest.mark.parametrize("width", [4, 20])
def test_dependent_columns_keep_the_gram_matrix(make, width):
    x = RNG.normal(size=(30, 10))
    x[:, 3], x[:, 7], x[:, 8] = 2 * x[:, 0], 0, x[:, 1] - x[:, 5]
    found = panels.panel_qr(make(x), width)
    r = upper(found.r, 10)
    assert found.dependent == 3
    assert np.allclose(r.T @ r, x.T @ x) and (np.diag(r) >= 0).all()
    with pytest.raises(ValueError, match="full column rank"):
        panels.thin_qr(make(x), width)


def test_more_columns_than_rows(make):
    x = RNG.normal(size=(5, 9))
    found = panels.panel_qr(make(x), 2)
    r = upper(found.r, 9)
    assert found.dependent == 4 and np.allclose(r.T @ r, x.T @ x)


def test_thin_qr_of_ill_conditioned_columns(make):
    # neighbouring panels are nearly dependent
    x = np.vander(np.linspace(0, 1, 60), 12)
    q, r = panels.thin_qr(make(x), 5)
    q, r = q.to_numpy(), upper(r, 12)
    assert np.abs(q.T @ q - np.eye(12)).max() < 1e-13
    assert np.abs(q @ r - x).max() < 1e-13
    assert (np.tril(r, -1) == 0).all() and (np.diag(r) > 0).all()


def test_least_squares_is_backward_stable(make):
    x = np.vander(np.linspace(0, 1, 80), 11)
    b = RNG.normal(size=(80, 2))
    got, residual = panels.least_squares(make(np.hstack([x, b])), 2, 4)
    want = np.linalg.lstsq(x, b, rcond=None)[0]
    assert np.allclose(residual, np.linalg.norm(x @ want - b, axis=0), rtol=1e-12)
    assert np.allclose(got, want, rtol=1e-6)


def test_wide_systems_take_the_panels(make, monkeypatch):
    monkeypatch.setattr(tsqr, "MAX_DIRECT_COLS", 8)
    monkeypatch.setattr(panels, "PANEL_COLS", 4)
    x, b = RNG.normal(size=(40, 10)), RNG.normal(size=(40, 2))
    want = np.linalg.lstsq(x, b, rcond=None)[0]
    for fit in (tsqr.least_squares(make(x), make(b)), tsqr.least_squares(make(np.hstack([x, b])), 2)):
        assert np.allclose(fit.x, want)
        assert np.allclose(fit.residual, np.linalg.norm(x @ want - b, axis=0))
    for lam, got in zip([0.0, 2.0], tsqr.ridge(make(x), make(b), [0.0, 2.0])):
        assert np.allclose(got, np.linalg.solve(x.T @ x + lam * np.eye(10), x.T @ b))
    short = RNG.normal(size=(6, 10))
    y = short @ np.ones((10, 1))
    assert np.allclose(
        tsqr.ridge(make(short), make(y), [0.5])[0], np.linalg.solve(short.T @ short + 0.5 * np.eye(10), short.T @ y)
    )
    with pytest.raises(ValueError, match="rank"):
        tsqr.ridge(make(short), make(y), [0.0])
    q, r = tsqr.thin_qr(make(x))
    assert np.allclose(q.to_numpy() @ upper(r, 10), x)




@pytest.mark.parametrize("width, tile_rows", [(3, 4), (4, 100), (100, 7)])
def test_gram_of_tiles(make, width, tile_rows):
    x = RNG.normal(size=(30, 11))
    x[7], x[:, 4] = 0, 0
    a = BlockedMatrix.from_tall(make(x), width, tile_rows)
    assert np.allclose(a.gram().to_numpy(), x.T @ x)
    a.release()


def test_gram_of_absent_blocks(spark):
    x = np.arange(24.0).reshape(4, 6)
    x[1, :3] = x[2] = 0
    rows = [(i, b, x[i, 3 * b : 3 * b + 3].tolist()) for i in range(4) for b in range(2) if x[i, 3 * b : 3 * b + 3].any()]
    a = BlockedMatrix(spark.createDataFrame(rows, "row_id LONG, block INT, v ARRAY<DOUBLE>"), 6, 4, 3, 2)
    assert np.allclose(a.gram().to_numpy(), x.T @ x)
    a.release()


def test_wide_gram_reads_the_matrix_once(make, monkeypatch):
    monkeypatch.setattr(products, "MAX_DIRECT_COLS", 8)
    x = RNG.normal(size=(20, 12))
    assert np.allclose(products.gram(make(x)).to_numpy(), x.T @ x)
