import numpy as np
import pytest
from plain_matrices import dense

from tallmat import PcaModel, pca
from tallmat.sources import index, readers, sinks

RNG = np.random.default_rng(8)
HEADER = readers.MM_HEADER


def write(path, text):
    path.write_text(text)
    return str(path)


def test_single_matrix_market_file(spark, tmp_path):
    # the size line looks like an entry and is also repeated as one
    text = f"{HEADER}\n% comment\n3 4 3\n1 1 0.5\n3 4 3\n2 3 -1e-20\n"
    m = readers.read_matrix_market_checked(spark, write(tmp_path / "a.mtx", text))
    assert (m.n_rows, m.n_cols, m.nnz) == (3, 4, 3)
    got = {(r.row_id, r.col_id): r.val for r in m.entries.collect()}
    assert got == {(0, 0): 0.5, (2, 3): 3.0, (1, 2): -1e-20}


@pytest.mark.parametrize(
    "body, message",
    [
        ("2 2 2\n1 1 1\n", "announces 2 entries and has 1"),
        ("2 2 2\n1 1 1\n1 1 2\n", "more than once"),
        ("2 2 2\n1 1 1\n3 1 2\n", "outside the matrix"),
        ("2 2 1\n1 1\n", "row column value"),
    ],
)
def test_malformed_matrix_market(spark, tmp_path, body, message):
    path = write(tmp_path / "bad.mtx", f"{HEADER}\n{body}")
    with pytest.raises(Exception, match=message):
        readers.read_matrix_market_checked(spark, path).entries.collect()


def test_other_matrix_market_kinds_are_refused(spark, tmp_path):
    path = write(tmp_path / "x.mtx", "%%MatrixMarket matrix array real general\n1 1\n2\n")
    with pytest.raises(ValueError, match="does not start with"):
        readers.read_matrix_market(spark, path)


def test_matrix_market_keeps_every_digit(spark, make, tmp_path):
    x = RNG.normal(size=(9, 4)) * 10.0 ** RNG.integers(-200, 200, size=(9, 4))
    path = str(tmp_path / "m")
    sinks.write_tall_matrix_market(make(x), 9, path)
    assert np.array_equal(dense(readers.read_matrix_market_checked(spark, path).coo(), (9, 4)), x)


def test_coo_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", "2,0,1.5\n0,7,2\n2,0,1\n")
    a = readers.read_coo_csv(spark, path)
    assert a.n_cols == 3
    assert {(r.row_id, r.col_id, r.val) for r in a.df.collect()} == {(0, 2, 2.5), (7, 0, 2.0)}
    bad = write(tmp_path / "b.csv", "1,x,1\n")
    with pytest.raises(Exception):
        readers.read_coo_csv(spark, bad, 4).df.collect()


def test_number_rows_is_dense_and_ordered(spark):
    keys = [int(k) for k in RNG.permutation(10_000)[:3000]]
    df = spark.createDataFrame([(k,) for k in keys], "key BIGINT").repartition(5)
    numbered, n = index.number_rows(df, ["key"], "number")
    assert n == 3000
    got = [(r.key, r.number) for r in numbered.orderBy("key").collect()]
    assert got == list(zip(sorted(keys), range(3000)))


def test_compaction_with_a_frequent_key(spark, monkeypatch):
    data = [("hot", f"c{j % 50:02d}", 1.0) for j in range(300)]
    data += [(f"r{i:03d}", f"c{i % 50:02d}", 2.0) for i in range(150)]
    df = spark.createDataFrame(data, "row_key STRING, col_key STRING, val DOUBLE")
    small = index.compact(df)
    monkeypatch.setattr(index, "MAX_BROADCAST_ROWS", 0)  # the split join
    large = index.compact(df)
    for c in (small, large):
        assert c.matrix.n_cols == 50 and c.rows.count() == 151
        got = {(r.row_id, r.col_id): r.val for r in c.matrix.df.collect()}
        assert got[(0, 3)] == 6.0 and got[(1, 0)] == 2.0 and len(got) == 200


def test_compacted_matrix_on_disk(spark, tmp_path):
    df = spark.createDataFrame(
        [(30, "b", 1.0), (10, "a", 2.0), (10, "c", 3.0)], "row_key BIGINT, col_key STRING, val DOUBLE"
    )
    compacted = index.compact(df)
    sinks.save_compacted(compacted, str(tmp_path / "m"))
    a, n_rows = readers.read_compacted(spark, str(tmp_path / "m"))
    assert n_rows == 2 and np.allclose(dense(a, (2, 3)), [[2, 0, 3], [0, 1, 0]])
    a, n_rows = readers.read_compacted(spark, str(tmp_path / "m"), 5, 6)
    assert n_rows == 5 and a.n_cols == 6
    sinks.write_dictionary(compacted.rows, "row_key", "row_id", str(tmp_path / "d"))
    assert [r.value for r in spark.read.text(str(tmp_path / "d")).collect()] == ["10", "30"]


def test_manifest_numbers_rows_without_gaps(spark, make, tmp_path):
    first, second = RNG.normal(size=(7, 3)), RNG.normal(size=(5, 3))
    make(first, 1).df.orderBy("row_id").coalesce(1).write.parquet(str(tmp_path / "one"))
    make(second, 3).df.write.parquet(str(tmp_path / "two"))
    text = f"{tmp_path}/one v 2\n{tmp_path}/two v 9\n"
    path = write(tmp_path / "manifest", text)
    a = readers.read_manifest(spark, path)
    x = a.to_numpy()
    assert a.df.rdd.getNumPartitions() <= 2
    assert np.array_equal(x[:7], first)
    assert sorted(map(tuple, x[7:])) == sorted(map(tuple, second))
    ordered = readers.read_manifest(spark, path, order_by="row_id").to_numpy()
    assert np.array_equal(ordered, np.vstack([first, second]))
    with pytest.raises(ValueError, match="path column partitions"):
        readers.read_manifest(spark, write(tmp_path / "short", "just/a/path\n"))


def test_dense_reader_with_columns(spark, tmp_path):
    df = spark.createDataFrame([(4, 1, 2.5), (6, 3, 0.5)], "id BIGINT, a INT, b DOUBLE")
    df.write.parquet(str(tmp_path / "t"))
    a = readers.read_dense(spark, str(tmp_path / "t"), ["b", "a"], "id", partitions=3)
    assert np.array_equal(a.to_numpy(), [[2.5, 1], [0.5, 3]])


def test_blocks_of_different_heights(spark):
    blocks = [(2, [[5.0, 6.0]]), (0, [[1.0, 2.0], [3.0, 4.0]]), (9, [[7.0, 8.0]])]
    df = spark.createDataFrame(blocks, "block_id INT, rows ARRAY<ARRAY<DOUBLE>>")
    assert np.array_equal(readers.from_blocks(df, 2).to_numpy(), [[1, 2], [3, 4], [5, 6], [7, 8]])


def test_model_round_trip(spark, make, tmp_path):
    x = RNG.normal(size=(12, 5))
    model = pca(make(x), 2, "standardizeEach")
    model.save(str(tmp_path / "pca"))
    back = PcaModel.load(spark, str(tmp_path / "pca"))
    assert back.meta == {
        "k": 2, "m": 12, "n": 5, "method": "exact", "preprocess": "standardizeEach", "seed": 0,
    }
    assert np.allclose(back.singular_values(), model.singular_values())
    assert np.allclose(back.u.to_numpy(), model.u.to_numpy())
    stds = [r["std"] for r in back.row_stats.orderBy("row_id").collect()]
    assert stds == pytest.approx(list(x.std(1, ddof=1)))
    sinks.export_model(back, str(tmp_path / "mm"))
    u = readers.read_matrix_market_checked(spark, str(tmp_path / "mm" / "colEOFs"))
    assert (u.n_rows, u.n_cols) == (12, 2)
    assert np.array_equal(dense(u.coo(), (12, 2)), back.u.to_numpy())
    s = readers.read_matrix_market_checked(spark, str(tmp_path / "mm" / "evalEOFs"))
    assert np.array_equal(dense(s.coo(), (2, 1))[:, 0], back.singular_values())


def test_checkpoint_folder_is_the_named_one(spark):
    from tallmat.session import _shared_dir, scratch_path

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert _shared_dir(spark) == named
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(_shared_dir(spark).rstrip("/"))
