"""Sparse rows packed for passes, against dense products."""

import numpy as np
import pytest
from plain_matrices import dense

from tallmat import CooMatrix
from tallmat.operators import centered, packed, svd

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("method, entries, most", [("none", 1 << 20, 1 << 24), ("standardizeEach", 7, 1 << 24), ("standardizeEach", 7, 1)])
def test_packed_products(make_coo, monkeypatch, method, entries, most):
    """Records of few entries, sums of tasks added on the driver or in the tree."""
    monkeypatch.setattr(packed, "RECORD_ENTRIES", entries)
    monkeypatch.setattr(packed, "MAX_LOCAL_ELEMS", most)
    x = RNG.normal(size=(25, 9)) * (RNG.random((25, 9)) < 0.4)
    x[3], x[:, 5] = 0, 0
    a, _ = centered.prepare_sparse(make_coo(x), method)
    want = x.copy()
    if method != "none":
        want = want - want.mean(axis=1, keepdims=True)
        std = want.std(axis=1, ddof=1, keepdims=True)
        want = want / np.where(std < 1e-4, 1, std)
    held, b = packed.PackedSparse(a), RNG.normal(size=(9, 3))
    assert np.allclose(dense(held.times_local(b), (25, 3)), want @ b)
    assert np.allclose(held.gram_times_local(b), want.T @ want @ b)
    held.release()


def test_a_null_row_is_a_row_and_a_null_column_raises(spark):
    rows = spark.createDataFrame([(None, 0, 2.0), (None, 2, 1.0), (5, 1, 3.0)], "row_id BIGINT, col_id BIGINT, val DOUBLE")
    held = packed.PackedSparse(CooMatrix(rows, 3))
    assert {r.row_id: r.v for r in held.times_local(np.ones((3, 1))).df.collect()} == {None: [3.0], 5: [3.0]}
    bad = spark.createDataFrame([(1, None, 2.0)], "row_id BIGINT, col_id BIGINT, val DOUBLE")
    with pytest.raises(Exception, match="NULL column id"):
        packed.PackedSparse(CooMatrix(bad, 3)).gram_times_local(np.ones((3, 1)))


def test_lanczos_passes_over_packed_rows_without_a_shuffle(spark, make_coo):
    """A pass over a sparse matrix is one stage: nothing is dealt or merged between tasks."""
    space = svd._LocalSpace(make_coo(RNG.normal(size=(30, 8))), 0)
    space.start(2)
    stages = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one pass", "one pass")
    try:
        space.residuals(np.eye(2), np.zeros(2))
        assert space.grow()
        jobs = [stages.getJobInfo(j) for j in stages.getJobIdsForGroup("one pass")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        space.release()
    ran = [i for j in jobs for i in j.stageIds if stages.getStageInfo(i) and stages.getStageInfo(i).numCompletedTasks]
    assert len(jobs) == 1 and len(ran) == 1
    t = space.v.T @ space.cv
    assert np.allclose(space.projected(), (t + t.T) / 2)
