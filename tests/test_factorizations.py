import importlib
import itertools

import numpy as np
import pytest
from plain_matrices import dense
from pyspark.sql import functions as F

from tallmat import CooMatrix, TallMatrix, cx_scores, nmf, pca
from tallmat.operators import centered, cx, fold, joined, nnls, preprocess, products, stats, svd, tsqr
from tallmat.operators.blocked import BlockedMatrix
from tallmat.operators.nmf import load_nmf, select_columns

pca_module = importlib.import_module("tallmat.operators.pca")

RNG = np.random.default_rng(11)


def low_rank(m, n, values, seed=0):
    rng = np.random.default_rng(seed)
    u = np.linalg.qr(rng.normal(size=(m, len(values))))[0]
    v = np.linalg.qr(rng.normal(size=(n, len(values))))[0]
    return u * values @ v.T


# -- folds and products -------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 4, 8])
def test_products_match_numpy(make, parts):
    x, b = RNG.normal(size=(30, 6)), RNG.normal(size=(6, 2))
    a = make(x, parts)
    assert np.allclose(products.gram_local(a), x.T @ x)
    assert np.allclose(products.gram(a).to_numpy(), x.T @ x)
    assert np.allclose(products.gram_columns(a, 2, 5).to_numpy(), x.T @ x[:, 2:5])
    assert np.allclose(products.times(a, b).to_numpy(), x @ b)
    assert np.allclose(products.gram_times(a, b).to_numpy(), x.T @ x @ b)
    assert np.allclose(products.covariance_times(a, b, 30).to_numpy(), x.T @ x @ b / 30)
    y = RNG.normal(size=(30, 3))
    assert np.allclose(products.transpose_times(a, make(y)).to_numpy(), x.T @ y)


def test_ones_on_the_right(make_coo):
    x = RNG.integers(0, 2, size=(40, 64)).astype(float)
    ones = np.ones((64, 32))
    got = products.gram_times_local(make_coo(x), ones)
    assert np.allclose(got, x.T @ x @ ones)


def test_merge_tree_with_several_levels(make, monkeypatch):
    assert fold.merge_levels(8, fold.FAN_IN) == 1
    assert fold.merge_levels(8000, fold.FAN_IN) == 3
    assert fold.merge_levels(8, fold.COSTLY_FAN_IN) == 2
    monkeypatch.setattr(fold, "FAN_IN", 2)
    monkeypatch.setattr(fold, "COSTLY_FAN_IN", 2)
    monkeypatch.setattr(fold, "SMALL_SUM", 0)
    x = RNG.normal(size=(60, 4))
    assert np.allclose(products.gram_local(make(x, 8)), x.T @ x)
    assert np.allclose(np.abs(tsqr.tsqr(make(x, 8)).r), np.abs(np.linalg.qr(x)[1]))


def test_tree_follows_the_data_not_the_cores(spark, monkeypatch):
    """1000 tasks on few cores: the scan keeps its partitions and more levels merge them."""
    monkeypatch.setattr(fold, "SMALL_SUM", 0)
    wide = spark.range(0, 2000, 1, 1000).selectExpr("id AS row_id", "array(1.0D, cast(id as double)) AS v")
    a = TallMatrix(wide, 2)
    assert fold.merge_levels(1000, fold.FAN_IN) == 2
    total = products._gram_sum(a)
    plan = total.parts._jdf.queryExecution().toString()
    assert "Coalesce" not in plan
    assert np.allclose(total.to_numpy(), [[2000, 1999000], [1999000, sum(i * i for i in range(2000))]])


def test_partials_are_cut_into_blocks(make, monkeypatch):
    monkeypatch.setattr(fold, "block_rows", lambda n_cols: 3)
    monkeypatch.setattr(fold, "SMALL_SUM", 0)
    x = RNG.normal(size=(20, 8))
    assert np.allclose(products.gram_local(make(x)), x.T @ x)
    assert np.allclose(products.gram(make(x)).to_numpy(), x.T @ x)


def test_empty_matrix_raises(spark):
    empty = TallMatrix(spark.createDataFrame([], "row_id BIGINT, v ARRAY<DOUBLE>"), 3)
    with pytest.raises(ValueError, match="no rows"):
        products.gram_local(empty)
    with pytest.raises(ValueError, match="no rows"):
        tsqr.tsqr(empty)


def test_size_limits():
    with pytest.raises(ValueError, match="too large"):
        fold.check_local(1 << 20, 1 << 20)


# -- joins of a sparse matrix with a table -------------------------------------


def skewed(spark):
    """A third of the entries in one column and a third in one row."""
    rng = np.random.default_rng(2)
    x = np.zeros((90, 80))
    x[:, 3] = rng.normal(size=90)
    x[7, :] = rng.normal(size=80)
    x[rng.integers(0, 90, 80), rng.integers(0, 80, 80)] = 1.0
    return x


@pytest.mark.parametrize("width", [2, 70])
def test_joined_products_with_hot_ids(spark, make, make_coo, width):
    x = skewed(spark)
    b, y = RNG.normal(size=(80, width)), RNG.normal(size=(90, width))
    held = joined.JoinedMatrix(make_coo(x))
    hot = {r.col_id: r.fan for r in held._by_col.hot.collect()}
    assert hot[3] > 1
    salts = held._by_col.entries.where("col_id = 3").select("salt").distinct().count()
    assert salts > 1
    assert np.allclose(dense(held.times(make(b)), (90, width)), x @ b)
    assert np.allclose(dense(held.transpose_times(make(y)), (80, width)), x.T @ y)
    held.release()


# -- QR and least squares -----------------------------------------------------


@pytest.mark.parametrize("shape", [(50, 6), (4, 6), (1, 3), (6, 6)])
def test_tsqr(make, shape):
    x = RNG.normal(size=shape)
    f = tsqr.tsqr(make(x))
    assert np.allclose(f.r.T @ f.r, x.T @ x)
    assert (np.diag(f.r) >= 0).all() and np.allclose(f.r, np.triu(f.r))
    assert np.allclose(f.col_l1, np.abs(x).sum(0)) and f.n_rows == shape[0]


def test_tsqr_is_independent_of_partitions_and_empty_ones(make):
    x = RNG.normal(size=(20, 5))
    rs = [tsqr.tsqr(make(x, p)).r for p in (1, 4, 40)]
    assert np.allclose(rs[0], rs[1], atol=1e-13) and np.allclose(rs[0], rs[2], atol=1e-13)


def test_thin_qr_of_badly_scaled_columns(make):
    x = RNG.normal(size=(200, 4)) @ np.diag([1, 1e3, 1e-3, 1e5])
    q, r = tsqr.thin_qr(make(x))
    q = q.to_numpy()
    assert np.abs(q.T @ q - np.eye(4)).max() < 1e-13
    assert np.allclose(q @ r, x)
    with pytest.raises(ValueError, match="full column rank"):
        tsqr.thin_qr(make(np.ones((5, 2))))


def test_least_squares_and_ridge(make):
    x, b = RNG.normal(size=(40, 3)), RNG.normal(size=(40, 2))
    fit = tsqr.least_squares(make(x), make(b))
    want = np.linalg.lstsq(x, b, rcond=None)[0]
    assert np.allclose(fit.x, want)
    assert np.allclose(fit.residual, np.linalg.norm(x @ want - b, axis=0))
    inside = tsqr.least_squares(make(np.hstack([x, b])), 2)
    assert np.allclose(inside.x, want) and np.allclose(inside.residual, fit.residual)
    for lam, got in zip([0.0, 2.0], tsqr.ridge(make(x), make(b), [0.0, 2.0])):
        assert np.allclose(got, np.linalg.solve(x.T @ x + lam * np.eye(3), x.T @ b))
    with pytest.raises(ValueError, match="rank"):
        tsqr.least_squares(make(np.ones((5, 2))), make(np.ones((5, 1))))


# -- SVD and PCA ----------------------------------------------------------------


@pytest.fixture(scope="module")
def decaying():
    return low_rank(60, 12, [50, 20, 9, 4, 2, 1, 0.5])


WAYS = {
    "direct": lambda a, c, k: svd.direct_svd(a, k),
    "randomized": lambda a, c, k: svd.randomized_svd(a, k, 3, 6),
    "randomized tables": lambda a, c, k: svd.randomized_svd(c, k, 3, 2, basis="table"),
    "krylov": lambda a, c, k: svd.krylov_svd(a, k),
    "krylov tables": lambda a, c, k: svd.krylov_svd(c, k, tol=1e-9, basis="table"),
}


@pytest.mark.parametrize("way", WAYS)
def test_svd_properties(make, make_coo, decaying, way):
    x, k = decaying, 2
    f = WAYS[way](make(x), make_coo(x), k)
    u, v = dense(f.u, (60, k)), dense(f.v, (12, k))
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(f.s, s[:k], rtol=1e-6)
    assert (np.diff(f.s) <= 0).all()
    assert np.allclose(u.T @ u, np.eye(k), atol=1e-8)
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-8)
    assert ((x - u * f.s @ v.T) ** 2).sum() == pytest.approx((s[k:] ** 2).sum(), rel=1e-5)
    assert (v[np.abs(v).argmax(0), np.arange(k)] > 0).all()


def test_regimes_agree_on_zero_rows_and_columns(make, make_coo):
    """Same row sets, values and signs whether the basis is local or a table."""
    x = low_rank(20, 6, [9, 4, 1])
    x[4], x[:, 2] = 0, 0
    found = [
        svd.direct_svd(make(x), 2),
        svd.krylov_svd(make(x), 2, basis="local"),
        svd.krylov_svd(make(x), 2, tol=1e-10, basis="table"),
        svd.randomized_svd(make(x), 2, 2, 8, basis="local"),
        svd.randomized_svd(make(x), 2, 2, 8, basis="table"),
    ]
    want = found[0].u.to_numpy(), found[0].s, found[0].v.to_numpy()
    for f in found:
        assert f.u.count() == 20 and f.v.count() == 6
        for got, expected in zip((f.u.to_numpy(), f.s, f.v.to_numpy()), want):
            assert np.allclose(got, expected, atol=1e-6)
    coo = svd.krylov_svd(make_coo(x), 2, tol=1e-10, basis="table")
    assert coo.u.count() == 19 and coo.v.count() == 6


@pytest.mark.parametrize("width, tile_rows", [(3, 4), (5, 100), (100, 7)])
def test_blocked_products(make, width, tile_rows):
    x = RNG.normal(size=(30, 11))
    x[7], x[:, 4] = 0, 0
    b, y = RNG.normal(size=(11, 3)), RNG.normal(size=(30, 2))
    a = BlockedMatrix.from_tall(make(x), width, tile_rows)
    assert np.allclose(a.times_local(b).to_numpy(), x @ b)
    assert np.allclose(a.gram_times_local(b), x.T @ (x @ b))
    assert np.allclose(a.transpose_times(make(y)).to_numpy(), x.T @ y)
    left, right = RNG.normal(size=(30, 2)), RNG.normal(size=(11, 2))
    assert a.squared_error(make(left), make(right)).first().val == pytest.approx(((x - left @ right.T) ** 2).sum(), rel=1e-12)
    a.release()


def test_absent_blocks_are_zero(spark):
    x = np.arange(24.0).reshape(4, 6)
    x[1, :3] = x[2] = 0
    rows = [(i, b, x[i, 3 * b : 3 * b + 3].tolist()) for i in range(4) for b in range(2) if x[i, 3 * b : 3 * b + 3].any()]
    a = BlockedMatrix(spark.createDataFrame(rows, "row_id LONG, block INT, v ARRAY<DOUBLE>"), 6, 4, 3, 2)
    b = RNG.normal(size=(6, 2))
    assert np.allclose(a.gram_times_local(b), x.T @ x @ b)
    want = np.linalg.svd(x, compute_uv=False)[:2]
    for basis in ("local", "table"):
        assert np.allclose(svd.krylov_svd(a, 2, tol=1e-10, basis=basis).s, want)
    assert np.allclose(svd.exact_svd(a, 2).s, want)
    a.release()


def test_wide_dense_pca_in_blocks(make, monkeypatch):
    """Above the direct limit no element leaves its array, U and V are right, and the error is that of residuals."""
    monkeypatch.setattr(svd, "MAX_DIRECT_COLS", 8)
    monkeypatch.setattr(pca_module, "MAX_DIRECT_COLS", 8)
    x = low_rank(40, 14, [30, 12, 5]) + 3
    model = pca(make(x), 2, method="exact", max_direct_cols=8)
    u, s, vt = np.linalg.svd(x - x.mean(axis=1, keepdims=True), full_matrices=False)
    assert np.allclose(model.singular_values(), s[:2])
    got = dense(model.u, (40, 2)) * model.singular_values() @ dense(model.v, (14, 2)).T
    assert np.allclose(got, (u[:, :2] * s[:2]) @ vt[:2], atol=1e-8)
    assert model.squared_error().first().val == pytest.approx((s[2:] ** 2).sum(), rel=1e-9)
    whole = pca(make(x), 3, method="randomized", max_direct_cols=8)
    assert whole.squared_error().first().val == pytest.approx(0, abs=1e-18)


@pytest.mark.parametrize("method", ["centerOverAllObservations", "standardizeEach", "cosLat+centerOverAllObservations"])
def test_sparse_preprocessing_fills_nothing(spark, make_coo, method):
    x = RNG.normal(size=(25, 9)) * (RNG.random((25, 9)) < 0.3)
    x[3], x[:, 5], x[8] = 0, 0, 0
    x[8, 2] = 4.0
    weights = spark.createDataFrame([(i, 1.0 / (1 + i)) for i in range(25)], "row_id LONG, weight DOUBLE")
    a = make_coo(x)
    tall, row_stats = preprocess.preprocess(a.to_tall(), method, weights)
    a.to_tall = None  # from here on nothing may make it dense
    want = np.zeros((25, 9))
    for r in tall.df.collect():
        want[r.row_id] = r.v
    sparse, sparse_stats = centered.prepare_sparse(a, method, weights)
    b = RNG.normal(size=(9, 2))
    assert np.allclose(dense(sparse.times_local(b), (25, 2)), want @ b)
    assert np.allclose(sparse.gram_times_local(b), want.T @ want @ b)
    assert sparse.squared_norm().first().val == pytest.approx((want**2).sum())
    order = sorted(sparse_stats.columns)
    for p, q in zip(row_stats.select(order).orderBy("row_id").collect(), sparse_stats.select(order).orderBy("row_id").collect()):
        assert all(v == pytest.approx(w) for v, w in zip(p, q))
    s = np.linalg.svd(want, compute_uv=False)[:2]
    for basis in ("local", "table"):
        f = svd.krylov_svd(sparse, 2, tol=1e-10, basis=basis)
        assert np.allclose(f.s, s)
        assert np.allclose(dense(f.u, (25, 2)) * f.s @ dense(f.v, (9, 2)).T @ b, want @ (f.v.to_numpy() @ f.v.to_numpy().T @ b))
    assert np.allclose(pca(a, 2, method, weights=weights).singular_values(), s)


@pytest.mark.parametrize("basis", ["local", "table"])
def test_krylov_raises_at_the_cap(make, basis):
    x = np.random.default_rng(5).normal(size=(90, 60))
    with pytest.raises(RuntimeError, match="did not converge"):
        svd.krylov_svd(make(x), 1, restarts=1, basis=basis)


def test_start_vectors_do_not_depend_on_the_regime(spark, make_coo):
    local = svd.gaussian_matrix(spark, 5, 3, 8)
    assert np.allclose(svd.gaussian_table(joined.JoinedMatrix(make_coo(np.ones((4, 5)))), 3, 8).to_numpy(), local)


def test_a_callers_cache_survives(make, decaying):
    a = make(decaying).keep()
    a.count()
    svd.randomized_svd(a, 2, 3, 1)
    svd.krylov_svd(a, 2)
    assert a.df.storageLevel.useMemory
    a.release()
    assert not a.df.storageLevel.useMemory


def test_column_reductions_of_an_empty_matrix(spark):
    for n in (32, 33):
        empty = TallMatrix(spark.createDataFrame([], "row_id BIGINT, v ARRAY<DOUBLE>"), n)
        rows = stats.col_sums(empty).orderBy("col_id").collect()
        assert [r.col_id for r in rows] == list(range(n)) and all(r.val is None for r in rows)


def test_top_columns_of_small_scores(spark):
    scores = spark.createDataFrame([(i, (i + 1) * 1e-13) for i in range(5)] + [(9, 0.0), (7, 5e-13)], "col_id BIGINT, p DOUBLE")
    assert [(r.col_id, r.pos) for r in cx.top_columns(scores, 3).orderBy("pos").collect()] == [(4, 0), (7, 1), (3, 2)]


def test_unfinished_least_squares_raise(monkeypatch):
    monkeypatch.setattr(nnls, "solve_nnls", lambda g, b: (np.zeros_like(b), np.zeros(len(b), bool)))
    with pytest.raises(RuntimeError, match="did not converge"):
        nnls.solved(np.eye(2), np.ones((1, 2)))


def test_krylov_restarts_on_a_flat_spectrum(make):
    x = RNG.normal(size=(80, 40))
    f = svd.krylov_svd(make(x), 2)
    assert np.allclose(f.s, np.linalg.svd(x, compute_uv=False)[:2], rtol=1e-10)


def test_exact_picks_the_regime(make, decaying):
    a = make(decaying)
    assert np.allclose(svd.exact_svd(a, 2).s, svd.exact_svd(a, 2, max_direct_cols=5).s)


def test_centering_loses_one_rank(make, monkeypatch):
    x = RNG.normal(size=(30, 4))
    model = pca(make(x), 4)
    assert model.k == 3
    centered = x - x.mean(1, keepdims=True)
    assert np.allclose(model.singular_values(), np.linalg.svd(centered, compute_uv=False)[:3])
    assert model.squared_error().first().val == pytest.approx(0, abs=1e-20)
    two = pca(make(x), 2)
    general = stats.squared_error(two.matrix, two.u, two.right_factor()).first().val
    assert two.squared_error().first().val == pytest.approx(general)
    with monkeypatch.context() as m:
        m.setattr(pca_module, "fits_locally", lambda rows, cols: False)
        assert two.squared_error().first().val == pytest.approx(general)


def test_smoke_shape_with_weights(spark, make):
    x = RNG.normal(size=(10, 4))
    weights = spark.createDataFrame([(i, 1 + i / 10) for i in range(10)], "row_id BIGINT, weight DOUBLE")
    model = pca(make(x), 3, "cosLat+centerOverAllObservations", weights=weights)
    want = (x - x.mean(1, keepdims=True)) * (1 + np.arange(10) / 10)[:, None]
    assert np.allclose(model.singular_values(), np.linalg.svd(want, compute_uv=False)[:3])
    stats_rows = model.row_stats.orderBy("row_id").collect()
    assert [r.weighted_mean for r in stats_rows] == pytest.approx(
        list(x.mean(1) * (1 + np.arange(10) / 10))
    )


def test_both_methods(make, decaying):
    exact, randomized = pca(make(decaying), 2, "none", "both")
    assert exact.meta["method"] == "exact" and randomized.meta["method"] == "randomized"
    assert np.allclose(exact.singular_values(), randomized.singular_values())
    with pytest.raises(ValueError, match="unknown method"):
        pca(make(decaying), 2, method="fast")
    with pytest.raises(ValueError, match="rank 13"):
        pca(make(decaying), 13)


def test_zero_matrix_has_no_components(make):
    with pytest.raises(ValueError, match="zero"):
        pca(make(np.ones((5, 3))), 1)


# -- NNLS and NMF -----------------------------------------------------------------


def test_nnls_recovers_a_known_factor(make):
    # n = 50 equations, 7 unknowns, 20 right-hand sides; basis = unit vectors
    basis = np.eye(50)[:, :7]
    h = np.hstack([np.eye(7), RNG.random((7, 13))])
    rows = nnls.nnls_rows(make((basis @ h).T), basis.T).orderBy("row_id").collect()
    assert np.abs(np.array([r.h for r in rows]).T - h).max() < 1e-10
    assert all(r.converged for r in rows)


def test_nnls_optimality(make):
    basis, targets = RNG.normal(size=(5, 12)), RNG.normal(size=(300, 12))
    rows = nnls.nnls_rows(make(targets), basis).orderBy("row_id").collect()
    h = np.array([r.h for r in rows])
    gradient = (h @ basis - targets) @ basis.T
    assert all(r.converged for r in rows)
    assert (h >= 0).all() and (gradient > -1e-9).all()
    assert np.abs(gradient * h).max() < 1e-9
    assert (h == 0).any() and (h > 0).any()


def test_weighted_nnls_equals_scaled(make):
    basis, targets = RNG.normal(size=(3, 6)), RNG.normal(size=(20, 6))
    w = np.array([1, 0.5, 2, 0, 3, 1e-25])
    root = np.where(w > 1e-20, np.sqrt(w), 0)
    plain = nnls.nnls_rows(make(targets * root), basis * root)
    ways = [nnls.nnls_rows(make(targets), basis, w), nnls.nnls_rows(make(targets), basis, root, True)]
    want = np.array([r.h for r in plain.orderBy("row_id").collect()])
    for way in ways:
        assert np.allclose([r.h for r in way.orderBy("row_id").collect()], want)


def separable(m, n, k, seed):
    rng = np.random.default_rng(seed)
    w = np.zeros((m, k))
    w[rng.permutation(m)[:k], np.arange(k)] = 1.0
    order = rng.permutation(n)
    h = np.hstack([np.eye(k), rng.random((k, n - k))])[:, order]
    return w @ h, {int(np.flatnonzero(order == i)[0]) for i in range(k)}


def nnls_by_enumeration(basis, x):
    """Best non-negative coefficients of each column of x over all supports."""
    k = basis.shape[1]
    out = np.zeros((k, x.shape[1]))
    for j in range(x.shape[1]):
        best = (x[:, j] ** 2).sum()
        for size in range(1, k + 1):
            for support in itertools.combinations(range(k), size):
                sub = basis[:, support]
                h = np.linalg.lstsq(sub, x[:, j], rcond=None)[0]
                error = ((x[:, j] - sub @ h) ** 2).sum()
                if (h >= 0).all() and error < best - 1e-12:
                    best = error
                    out[:, j] = 0
                    out[list(support), j] = h
    return out


@pytest.mark.parametrize("score", ["positive_part", "norm"])
@pytest.mark.parametrize("seed", range(4))
def test_selection_follows_its_definition(score, seed):
    rng = np.random.default_rng(seed)
    x = rng.random((30, 9)) * (rng.random((30, 9)) < 0.5)
    picks, h = select_columns(x.T @ x, 3, score)
    chosen, residual = [], x
    for _ in range(3):
        c = residual.T @ x
        part = np.maximum(c, 0) if score == "positive_part" else c
        values = np.linalg.norm(part, axis=0) / np.linalg.norm(x, axis=0)
        values[chosen] = -1
        chosen.append(int(values.argmax()))
        want = nnls_by_enumeration(x[:, chosen], x)
        residual = x - x[:, chosen] @ want
    assert picks == chosen
    assert np.allclose(h, want, atol=1e-7)


@pytest.mark.parametrize("score", ["positive_part", "norm"])
def test_nmf_of_a_separable_matrix(make, score):
    x, truth = separable(2000, 60, 7, seed=5)
    x = x * (1 + np.arange(60))  # column sums far from 1
    a = make(x, 8)
    model = nmf(a, 7, score)
    assert len(set(model.picks)) == 7 and set(model.picks) & truth
    h = model.h_local
    assert (h >= 0).all()
    got = stats.relative_error(a, model.w, h).first().val
    assert model.relative_error().first().val == pytest.approx(got)
    assert got == pytest.approx(np.linalg.norm(x - x[:, model.picks] @ h) / np.linalg.norm(x))
    assert got < 0.5
    # the same selection from the table of A'A
    wide = nmf(a, 7, score, max_direct_cols=8)
    assert wide.picks == model.picks
    table = np.zeros((7, 60))
    for r in wide.h.collect():
        table[r.comp, r.col_id] = r.h
    assert np.allclose(table, h, atol=1e-6)
    assert wide.relative_error().first().val == pytest.approx(got)


def test_given_columns_reproduce_a_separable_matrix():
    x, truth = separable(50, 20, 7, seed=4)
    chosen = sorted(truth)
    g = x.T @ x
    h = nnls.solve_nnls(g[np.ix_(chosen, chosen)], g[chosen].T)[0].T
    assert np.allclose(x[:, chosen] @ h, x)


def test_nmf_zero_columns_and_ties(make):
    x = np.array([[1.0, 0, 1, 0], [0, 0, 0, 2], [0, 0, 0, 0]])
    model = nmf(make(x), 2)
    assert model.picks == [0, 3] or model.picks == [3, 0]
    assert np.allclose(model.h_local[:, 1], 0)
    with pytest.raises(ValueError, match="are not zero"):
        nmf(make(x), 4)
    with pytest.raises(Exception, match="negative element"):
        nmf(make(-x), 1, negatives="error")


def test_nmf_saves(spark, make, tmp_path):
    x, _ = separable(30, 8, 3, seed=1)
    model = nmf(make(x), 3)
    model.save(str(tmp_path / "nmf"))
    parts = load_nmf(spark, str(tmp_path / "nmf"))
    assert [r.col_id for r in parts["columns"].orderBy("rank_pos").collect()] == model.picks
    assert parts["w"].count() == 30 and parts["h"].count() == 24


# -- CX -----------------------------------------------------------------------------


def test_cx_scores(make_coo):
    x = low_rank(40, 15, [9, 5, 2, 1, 0.5])
    x[5] = 0
    for basis in ("local", "table"):
        scores = cx_scores(make_coo(x), 2, 4, 4, basis=basis)
        u, s, vt = np.linalg.svd(x)
        assert [r.s for r in scores.s.orderBy("comp").collect()] == pytest.approx(list(s[:2]))
        rows = {r.row_id: r.p for r in scores.row_lev.collect()}
        cols = {r.col_id: r.p for r in scores.col_lev.collect()}
        assert 5 not in rows or rows[5] == 0
        assert sum(rows.values()) == pytest.approx(1) and sum(cols.values()) == pytest.approx(1)
        assert [cols[j] for j in range(15)] == pytest.approx(list((vt[:2] ** 2).sum(0) / 2), abs=1e-6)


def test_absent_rows_score_zero(spark, make_coo):
    x = np.diag([3.0, 0.0, 1.0])
    scores = cx_scores(make_coo(x), 2, 1, 2)
    rows = scores.dense_rows(spark.range(3).toDF("row_id")).orderBy("row_id").collect()
    assert [r.p for r in rows] == pytest.approx([0.5, 0, 0.5])
    cols = scores.dense_cols(spark.range(3).toDF("col_id")).orderBy("col_id").collect()
    assert [r.p for r in cols] == pytest.approx([0.5, 0, 0.5])


def test_leverage_is_over_the_stated_rank(make_coo):
    x = low_rank(20, 6, [5, 2])
    scores = cx_scores(make_coo(x), 4, 1, 3)
    _, _, vt = np.linalg.svd(x)
    cols = {r.col_id: r.p for r in scores.col_lev.collect()}
    assert [cols[j] for j in range(6)] == pytest.approx(list((vt[:2] ** 2).sum(0) / 4), abs=1e-6)


@pytest.mark.parametrize("per_task", [50, 1 << 16])
def test_draws_hit_the_cumulated_mass(spark, monkeypatch, per_task):
    monkeypatch.setattr(cx, "BUCKET", 64)
    monkeypatch.setattr(cx, "DRAWS", per_task)
    p = np.random.default_rng(1).integers(0, 4, 1000) / 1024.0
    p[70] = 4.0
    df = spark.createDataFrame([(j, float(x)) for j, x in enumerate(p)], "col_id BIGINT, p DOUBLE")
    drawn = {r.pos: r for r in cx.sample_columns(df, 3000, seed=5).collect()}
    assert len(drawn) == 3000
    ends = np.cumsum(p)
    u = np.random.default_rng(5).random(3000) * ends[-1]
    # sums of multiples of 1/1024 are exact
    assert [drawn[k].col_id for k in range(3000)] == np.searchsorted(ends, u, side="right").tolist()
    assert all(r.p == p[r.col_id] and r.scale == pytest.approx((3000 * r.p) ** -0.5) for r in drawn.values())


def test_a_million_draws_make_no_pairs(spark):
    df = spark.range(100_000).select(F.col("id").alias("col_id"), (1.0 / (F.col("id") + 1)).alias("p"))
    drawn = cx.sample_columns(df, 1_000_000, seed=2)
    top = drawn.groupBy("col_id").count().where("col_id = 0").first()["count"]
    mass = (1 / (np.arange(100_000) + 1.0)).sum()
    assert drawn.count() == 1_000_000 and abs(top / 1e6 - 1 / mass) < 0.002
    with pytest.raises(ValueError):
        cx.sample_columns(df.where("p < 0"), 5, seed=1)


def test_sampling_follows_the_probabilities(spark, monkeypatch):
    monkeypatch.setattr(cx, "BUCKET", 3)
    p = np.array([0.5, 0.0, 0.1, 0.05, 0.2, 0.05, 0.1, 0.0])
    df = spark.createDataFrame([(j, float(x)) for j, x in enumerate(p)], "col_id BIGINT, p DOUBLE")
    drawn = cx.sample_columns(df, 4000, seed=3).collect()
    assert sorted(r.pos for r in drawn) == list(range(4000))
    share = np.bincount([r.col_id for r in drawn], minlength=8) / 4000
    assert np.abs(share - p).max() < 0.03 and share[1] == 0
    again = cx.sample_columns(df, 4000, seed=3).collect()
    assert {(r.pos, r.col_id) for r in drawn} == {(r.pos, r.col_id) for r in again}


@pytest.mark.parametrize("basis", ["local", "table"])
def test_cx_fit(make_coo, spark, basis):
    x = low_rank(40, 10, [9, 5, 2, 1])
    a = make_coo(x)
    chosen = spark.createDataFrame([(4, 0), (1, 1), (4, 2)], "col_id BIGINT, pos BIGINT")
    c = cx.chosen_columns(a, chosen, 3)
    assert np.allclose(dense(c, (40, 3)), x[:, [4, 1, 4]])
    fit = cx.fit_x(a, chosen, 3, basis=basis)
    best = x[:, [4, 1]] @ np.linalg.lstsq(x[:, [4, 1]], x, rcond=None)[0]
    want = np.linalg.norm(x - best) / np.linalg.norm(x)
    assert fit.relative_error.first().val == pytest.approx(want)
    got = dense(c, (40, 3)) @ dense(fit.x, (10, 3)).T
    assert np.allclose(got, best)
    scaled = cx.chosen_columns(a, chosen.withColumn("scale", F.lit(2.0)), 3, scaled=True)
    assert np.allclose(dense(scaled, (40, 3)), 2 * x[:, [4, 1, 4]])


def test_large_factors_are_broadcast(make, monkeypatch):
    monkeypatch.setattr(fold, "CLOSURE_BYTES", 0)
    x = RNG.random((30, 12))
    b = RNG.normal(size=(12, 2))
    assert np.allclose(products.times(make(x), b).to_numpy(), x @ b)
    assert np.allclose(products.gram_times(make(x), b).to_numpy(), x.T @ x @ b)
    assert np.allclose(products.gram_times_local(make(x), b), x.T @ x @ b)
    wide, direct = nmf(make(x), 3, max_direct_cols=4), nmf(make(x), 3)
    assert wide.picks == direct.picks
    assert wide.relative_error().first().val == pytest.approx(direct.relative_error().first().val)
    assert np.allclose(svd.randomized_svd(make(x), 2, 10, 2).s, svd.direct_svd(make(x), 2).s)


def _few_entries(make_coo, rows=12, n=4100):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(rows, n)) * (rng.random((rows, n)) < 0.02)
    return make_coo(x), x


def test_wide_matrices_of_few_entries_are_never_filled(make_coo, monkeypatch):
    """The dense view of a sparse matrix is factored and judged by its entries."""
    a, x = _few_entries(make_coo)
    tall = a.to_tall()
    monkeypatch.setattr(BlockedMatrix, "from_tall", None)
    monkeypatch.setattr("tallmat.operators.batches.scatter_blocks", None)
    want = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(svd.exact_svd(tall, 2).s, want[:2], rtol=1e-10)
    model = pca(tall, 2, "none")
    assert np.isclose(model.squared_error().first().val, (want[2:] ** 2).sum(), rtol=1e-9)


def test_wide_matrices_of_many_entries_stay_in_tiles(make_coo):
    a, x = _few_entries(make_coo)
    a.df = a.df.unionByName(a.df.sparkSession.range(4100).selectExpr("0L AS row_id", "id AS col_id", "1e-9 AS val"))
    assert isinstance(svd.stored(type(a)(a.df, 4100).to_tall()), TallMatrix)


def test_transposed_lanczos(make_coo, spark):
    a, x = _few_entries(make_coo)
    # row ids may be any numbers, and a row without an id is a row
    df = a.df.withColumn("row_id", F.when(F.col("row_id") > 0, F.col("row_id") * 1000))
    f = svd.transposed_svd(type(a)(df, 4100), 2)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    signs = svd.sign_fix(vt[:2].T)
    assert np.allclose(f.s, s[:2], rtol=1e-10)
    assert np.allclose(f.v.to_numpy(), vt[:2].T * signs, atol=1e-8)
    got = {r.row_id: r.v for r in f.u.df.collect()}
    want = x @ (vt[:2].T * signs) / s[:2]
    assert all(np.allclose(got[1000 * i if i else None], want[i], atol=1e-8) for i in range(len(x)))
    assert svd.transposed_svd(type(a)(a.df, 12), 2) is None


def test_krylov_tells_close_values_apart(make):
    """Singular values at the edge of a dense spectrum, which a basis of six blocks did not reach in 150 passes."""
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(800, 800)))[0]
    values = 1 - 0.4 * np.arange(800) / 800
    f = svd.krylov_svd(make((q * values).T), 2)
    assert np.allclose(f.s, values[:2], rtol=1e-9)


def test_narrow_tables_of_rows_are_not_placed_by_column(make_coo, make, monkeypatch):
    """The same products with the other factor sent to the rows, and without."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 6)) * (rng.random((30, 6)) < 0.6)
    b = rng.normal(size=(6, 3))
    monkeypatch.setattr(joined, "SLICE", 2)
    for limit in (None, 0):
        if limit is not None:
            monkeypatch.setattr(joined, "MAX_BROADCAST_ROWS", limit)
        a = joined.JoinedMatrix(make_coo(x))
        got = dense(a.times(make(b)), (30, b.shape[1]))
        assert np.allclose(got, x @ b) and np.allclose(dense(a.gram_times(make(b)), (6, b.shape[1])), x.T @ x @ b)
        assert (a._col is None) == (limit is None)
        a.release()


def test_more_columns_than_a_dense_row_may_have(spark):
    """The view of such a matrix goes on by its entries: the leading triple, the randomized one and the error."""
    n = (1 << 24) + 5
    x = np.random.default_rng(21).normal(size=(6, 9))
    cols = [0, 1, 7, 1000, 99_999, 5_000_000, 1 << 23, n - 2, n - 1]
    data = [(int(i), int(c), float(x[i, j])) for i in range(6) for j, c in enumerate(cols)]
    a = CooMatrix(spark.createDataFrame(data, "row_id BIGINT, col_id BIGINT, val DOUBLE"), n).to_tall()
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(svd.exact_svd(a, 1).s, s[:1])
    model = pca(a, 1, "none")
    assert model.squared_error().first().val == pytest.approx((s[1:] ** 2).sum())
    with pytest.raises(Exception, match="too many for dense rows"):
        a.df.collect()
