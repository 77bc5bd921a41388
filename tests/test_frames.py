import numpy as np
import pytest
from plain_matrices import dense
from pyspark.sql import functions as F

from tallmat import CooMatrix, TallMatrix
from tallmat.functions import arrays
from tallmat.functions.noise import normal
from tallmat.operators import preprocess as pre
from tallmat.operators import stats
from tallmat.sources import readers

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("parts", [1, 4, 8])
def test_round_trip_under_any_partitioning(make, parts):
    x = RNG.normal(size=(6, 3))
    assert np.array_equal(make(x, parts).to_numpy(), x)


def test_to_numpy_refuses_large(make):
    with pytest.raises(ValueError, match="more than 5 elements"):
        make(np.ones((3, 2))).to_numpy(max_elems=5)


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_values_raise(spark, bad):
    df = spark.createDataFrame([(0, [1.0, bad])], "row_id BIGINT, v ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="NULL or NaN"):
        TallMatrix.from_arrays(df, 2).df.collect()
    coo = spark.createDataFrame([(0, 0, bad)], "row_id BIGINT, col_id BIGINT, val DOUBLE")
    with pytest.raises(Exception, match="NULL, NaN"):
        CooMatrix(coo, 2, canonical=True).validated().df.collect()


def test_finite_keeps_clean_rows(spark):
    df = spark.createDataFrame([([1.0, -2.0],), ([0.0, 3.0],)], "v ARRAY<DOUBLE>")
    assert df.select(arrays.finite(F.col("v")).alias("v")).collect() == df.collect()


def test_ragged_rows_raise(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "row_id BIGINT, v ARRAY<DOUBLE>")
    with pytest.raises(ValueError, match="between 1 and 2"):
        TallMatrix.from_arrays(df)
    with pytest.raises(Exception, match="ragged"):
        TallMatrix.from_arrays(df, 2).dims().collect()


def test_only_double_columns(spark):
    df = spark.createDataFrame([(0, 1.0, 2)], "row_id BIGINT, a DOUBLE, b INT")
    with pytest.raises(TypeError, match="b"):
        TallMatrix.from_columns(df, ["a", "b"])


def test_duplicates_are_summed(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 0, 3.0)], "row_id BIGINT, col_id BIGINT, val DOUBLE")
    assert CooMatrix(df, 1).df.collect()[0].val == 5.0


def test_operands_must_match(make):
    with pytest.raises(ValueError, match="columns"):
        make(np.ones((2, 2))) + make(np.ones((2, 3)))
    with pytest.raises(Exception, match="row ids"):
        (make(np.ones((2, 2))) + make(np.ones((3, 2)))).df.collect()
    with pytest.raises(ZeroDivisionError):
        make(np.ones((2, 2))) / 0


def test_slices_are_half_open(make):
    x = np.arange(20.0).reshape(5, 4)
    assert np.array_equal(make(x).slice((1, 3), (0, 2)).to_numpy(), x[1:3, 0:2])
    with pytest.raises(IndexError):
        make(x).col_slice(2, 5)


def test_row_slice_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a = TallMatrix.from_arrays(df, 64, "vec_id", "embedding").row_slice(3, 9)
    plan = a.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,3)" in plan and "LessThan(vec_id,9)" in plan
    assert "label" not in plan


def test_segments_bound_the_record(make_coo):
    x = np.ones((2, 10))
    rows = make_coo(x).segments(width=4).collect()
    assert sorted((r.row_id, r.segment, len(r.idx)) for r in rows) == [
        (i, s, size) for i in range(2) for s, size in ((0, 4), (1, 4), (2, 2))
    ]


def test_sparse_dense_conversions(make_coo, make):
    x = RNG.integers(0, 3, size=(7, 5)).astype(float)
    assert np.array_equal(dense(make_coo(x).to_tall(), x.shape), x)
    sparse = make(np.vstack([x, np.zeros((1, 5))])).to_coo()
    assert np.array_equal(dense(sparse, (8, 5)), np.vstack([x, np.zeros((1, 5))]))
    rows = {r.row_id: (r.idx, r.val) for r in sparse.sparse_rows().collect()}
    assert rows == {
        i: (list(np.flatnonzero(x[i])), list(x[i][x[i] != 0])) for i in range(7) if x[i].any()
    }


def test_dense_blocks_are_cut(make_coo, monkeypatch):
    from tallmat.operators import batches

    monkeypatch.setattr(batches, "DENSE_BLOCK_ELEMS", 10)
    from tallmat.operators import products

    x = RNG.integers(0, 3, size=(23, 4)).astype(float)
    a, b = make_coo(x), RNG.normal(size=(4, 3))
    assert np.array_equal(dense(a.to_tall(), x.shape), x)
    assert np.allclose(products.gram_local(a), x.T @ x)
    assert np.allclose(products.gram_times_local(a, b), x.T @ x @ b)
    assert np.allclose(dense(products.times(a, b), (23, 3)), x @ b)


def test_reductions_do_not_start_from_zero(make):
    x = -1.0 - RNG.random((4, 3))
    a = make(x)
    for how, want in (("max", x.max()), ("min", x.min()), ("product", x.prod()), ("sum", x.sum())):
        assert stats.reduce_all(a, how).first()[0] == pytest.approx(want)
    rows = stats.reduce_rows(make(x[:, :1]), lambda p, q: p * q).orderBy("row_id").collect()
    assert [r.val for r in rows] == pytest.approx(list(x[:, 0]))


def test_column_sums_of_any_width(make):
    x = RNG.normal(size=(9, 40))
    for f, want in (
        (stats.col_sums, x.sum(0)),
        (stats.col_norms_l1, np.abs(x).sum(0)),
        (stats.col_norms_l2, np.linalg.norm(x, axis=0)),
    ):
        got = [r.val for r in f(make(x)).orderBy("col_id").collect()]
        assert got == pytest.approx(list(want))
    wide = RNG.normal(size=(3, 210))
    got = [r.val for r in stats.reduce_cols(make(wide), F.max).orderBy("col_id").collect()]
    assert got == pytest.approx(list(wide.max(0)))


def test_constant_row_keeps_std_one(make):
    a = make([[2.0, 2.0, 2.0], [0.0, 3.0, 6.0]])
    rows = stats.row_mean_std(a).orderBy("row_id").collect()
    assert [(r["mean"], r["std"], r.low_std) for r in rows] == [(2.0, 1.0, True), (3.0, 3.0, False)]
    assert np.allclose(pre.standardize_rows(a).to_numpy(), [[0, 0, 0], [-1, 0, 1]])


@pytest.mark.parametrize("method", pre.METHODS)
def test_block_preparation_equals_columns(spark, make, method):
    from tallmat.operators.products import map_blocks

    x = np.vstack([RNG.normal(size=(5, 4)), np.full((1, 4), 3.0)])
    weights = spark.createDataFrame([(i, i / 3) for i in range(6)], "row_id BIGINT, weight DOUBLE")
    a, _ = pre.preprocess(make(x), method, weights if "cosLat" in method else None)
    assert np.allclose(a.to_numpy(), map_blocks(a, lambda b: b).to_numpy(), atol=1e-14)


def test_preprocess_errors(spark, make):
    with pytest.raises(ValueError, match="unknown preprocessing"):
        pre.preprocess(make(np.ones((2, 2))), "center")
    with pytest.raises(ValueError, match="needs weights"):
        pre.preprocess(make(np.ones((2, 2))), "cosLat+centerOverAllObservations")
    few = spark.createDataFrame([(0, 1.0)], "row_id BIGINT, weight DOUBLE")
    with pytest.raises(Exception, match="no weight for row 1"):
        pre.weight_rows(make(np.ones((2, 2))), few).df.collect()


def test_saved_statistics_can_be_reused(make):
    x = RNG.normal(size=(4, 5))
    saved = stats.row_mean_std(make(x))
    assert np.allclose(
        pre.standardize_rows(make(x), saved).to_numpy(), pre.standardize_rows(make(x)).to_numpy()
    )


def test_smoke_latitudes(spark):
    # fixed values of the 10-row smoke input
    lat = [0, 89, 72, 0, 0, 0, -86.2, 0, 0, 0]
    df = spark.createDataFrame(list(enumerate(map(float, lat))), "row_id BIGINT, lat DOUBLE")
    got = [r.weight for r in pre.latitude_weights(df).orderBy("row_id").collect()]
    assert got == pytest.approx(list(np.sqrt(np.cos(np.radians(lat)))))
    over = spark.createDataFrame([(0, 91.0)], "row_id BIGINT, lat DOUBLE")
    with pytest.raises(Exception, match="latitude out of range"):
        pre.latitude_weights(over).collect()


def test_negative_modes(make):
    from tallmat.operators.products import map_blocks

    a = make([[-1.0, 2.0]])
    clamped = pre.non_negative(a, "clamp_log")
    assert np.allclose(clamped.to_numpy(), [[0, np.log(3)]])
    assert np.allclose(map_blocks(clamped, lambda x: x).to_numpy(), [[0, np.log(3)]])
    assert np.allclose(pre.non_negative(a, "keep").to_numpy(), [[-1, 2]])
    with pytest.raises(Exception, match="negative element"):
        pre.non_negative(a).df.collect()
    with pytest.raises(Exception, match="negative element"):
        map_blocks(pre.non_negative(a), lambda x: x).df.collect()
    assert np.allclose(pre.non_negative(make([[1.0, 2.0]])).to_numpy(), [[1, 2]])


def test_random_values_do_not_depend_on_partitions(spark):
    one = readers.random_uniform(spark, 101, 6, 1, seed=9)
    many = readers.random_uniform(spark, 101, 6, 7, seed=9)
    x = one.to_numpy()
    assert x.shape == (101, 6)
    assert np.array_equal(x, many.to_numpy())
    assert not np.array_equal(x, readers.random_uniform(spark, 101, 6, 7, seed=10).to_numpy())
    assert 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.06


def test_normal_draws(spark):
    ids = spark.range(4000).toDF("row_id")
    x = readers.random_rows(ids, 5, 1, draw=normal).to_numpy()
    assert abs(x.mean()) < 0.04 and abs(x.std() - 1) < 0.03
    assert np.allclose(np.corrcoef(x.T), np.eye(5), atol=0.08)


def test_placed_matrices_combine_without_a_shuffle(make):
    x, y = RNG.normal(size=(20, 3)), RNG.normal(size=(20, 3))
    a, b = make(x).placed(6).keep(), make(y).placed(6).keep()
    a.count(), b.count()
    total = a + b
    plan = total.df._jdf.queryExecution().executedPlan().toString()
    joined = plan[: plan.index("InMemoryRelation")]
    assert "Exchange" not in joined
    assert np.array_equal(total.to_numpy(), x + y)
    a.release(), b.release()


def test_saved_rows_are_read_without_a_shuffle(spark, make_coo, tmp_path):
    from tallmat.sources import sinks

    x = RNG.integers(0, 3, size=(9, 6)).astype(float)
    sinks.write_rows(make_coo(x), str(tmp_path / "rows"))
    a = readers.read_segments(spark, str(tmp_path / "rows"), 6)
    assert "Exchange" not in a.sparse_rows()._jdf.queryExecution().executedPlan().toString()
    assert np.array_equal(dense(a, x.shape), x)
    assert np.array_equal(dense(a.to_tall(), x.shape), x)
