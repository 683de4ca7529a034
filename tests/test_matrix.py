import numpy as np
import pytest

from matrixloom import csr_from_arrays, dense_from_numpy, tools
from matrixloom.operators import axis, matrix, names, partition

INDPTR = [0, 3, 3, 5, 6, 9, 10, 12, 15]
INDICES = [0, 3, 8, 1, 7, 4, 0, 2, 8, 6, 1, 5, 0, 4, 8]
DATA = np.array([7 * i + 3 for i in range(15)], np.uint16)
ROWS = [slice(0, 8), slice(2, 7), [7, 0, 7, 3], slice(7, None, -2), np.isin(np.arange(8), [0, 2, 5, 7])]
COLS = [slice(0, 1), slice(2, 7), [8, 0, 8, 3], slice(8, None, -3), []]


def full(data, indices, indptr, shape):
    out = np.zeros(shape, data.dtype)
    for r in range(shape[0]):
        out[r, indices[indptr[r] : indptr[r + 1]]] = data[indptr[r] : indptr[r + 1]]
    return out


@pytest.fixture(scope="module")
def grid(spark):
    return csr_from_arrays(spark, DATA, INDICES, INDPTR, (8, 9)), full(DATA, INDICES, INDPTR, (8, 9))


@pytest.mark.parametrize("r", range(5))
def test_axis_grid(grid, r):
    """Every row key with every column key, sparse and dense."""
    m, a = grid
    d = dense_from_numpy(m.spark, a)
    for c in COLS:
        cols = np.array(c, np.int64) if isinstance(c, list) else c
        want = a[ROWS[r]][:, cols]
        got = m.select(ROWS[r], c)
        assert got.shape == want.shape
        np.testing.assert_array_equal(got.to_numpy(), want)
        np.testing.assert_array_equal(d.select(ROWS[r], c).to_numpy(), want)
        for row in got.frame.collect():  # columns ascend
            assert list(row.indices) == sorted(set(row.indices))


def test_golden_selections(spark):
    d = dense_from_numpy(spark, np.arange(16, dtype=np.uint16).reshape(8, 2))
    assert d.select([7, 0, 7], [1, 0]).to_numpy().ravel().tolist() == [15, 14, 1, 0, 15, 14]
    assert d[slice(6, 0, -2)].to_numpy()[:3].ravel().tolist() == [12, 13, 8, 9, 4, 5]
    m = csr_from_arrays(spark, np.arange(10, 18), [r % 3 for r in range(8)], np.arange(9), (8, 3)).select([7, 0, 7], [1, 0, 1])
    data, indices, indptr = m.tocsr()
    assert (indptr.tolist(), indices.tolist(), data.tolist()) == ([0, 2, 3, 5], [0, 2, 1, 0, 2], [17, 17, 10, 17, 17])
    diag = csr_from_arrays(spark, np.arange(10, 14), range(4), np.arange(5), (4, 4)).select(np.array([True, False, True, False]), [3, 2, 1, 0])
    data, indices, indptr = diag.tocsr()
    assert (indptr.tolist(), indices.tolist(), data.tolist()) == ([0, 1, 2], [3, 1], [10, 12])


def test_keys(spark):
    d = dense_from_numpy(spark, np.arange(12, dtype=np.float32).reshape(4, 3))
    assert d[1].tolist() == [3, 4, 5] and d[-1, -1] == 11 and d[:, 1].tolist() == [1, 4, 7, 10]
    assert d[()].shape == (4, 3) and d[..., None].shape == (4, 3) and d[np.array([[1], [2]])].shape == (2, 3)
    s = csr_from_arrays(spark, np.array([20, 0, 10]), [2, 0, 1], [0, 2, 3], (2, 3))
    assert s.nnz == 3 and s[0].shape == (1, 3) and s[1, 1] == 10 and s[0].kind == "csr"
    for key, error in (((1, 1, 1), IndexError), (4, IndexError), (-5, IndexError), (True, TypeError), (np.ones(3, bool), IndexError), ([0.5], IndexError), (np.zeros((2, 2), int), IndexError), ("x", TypeError)):
        with pytest.raises(error):
            d[key]


def test_axis_forms():
    n = lambda k: axis.normalize_axis(k, 10)[0]
    assert n([3, 4, 5]).kind == "range" and n([9, 7, 5]).kind == "strided" and n([1, 1]).kind == "positions" and n(slice(None)).kind == "all"
    for k in ([3, 4, 5], [9, 7, 5], [4, 0, 4], slice(9, None, -3), slice(5, 2), []):
        want = np.arange(10)[k] if not isinstance(k, list) else np.arange(10)[np.array(k, int)]
        assert n(k).positions().tolist() == want.tolist()


def test_range_filter_is_pushed_down(spark, tmp_path):
    dense_from_numpy(spark, np.arange(64, dtype=np.float64).reshape(16, 4)).frame.write.parquet(str(tmp_path / "d"))
    d = matrix.DenseFrame(spark.read.parquet(str(tmp_path / "d")), 16, 4, matrix.dtype("f64"))
    plan = d.select(slice(3, 9)).frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row,3)" in plan and "LessThan(row,9)" in plan and "Exchange" not in plan


def test_extreme_values(spark):
    for a in (np.array([[-(2**63), 2**53 + 1], [2**63 - 1, 0]]), np.array([[2**64 - 1, 2**63 + 1], [0, 2**53 + 1]], np.uint64), np.array([[np.nan, -0.0, np.inf]], np.float32)):
        got = dense_from_numpy(spark, a).to_numpy()
        assert got.dtype == a.dtype and got.tobytes() == a.tobytes()
    for shape in ((3, 0), (0, 3), (0, 0)):
        d = dense_from_numpy(spark, np.empty(shape))
        assert d.to_numpy().shape == shape and d.select(slice(0, 2), slice(0, 1)).shape == (min(2, shape[0]), min(1, shape[1]))


def test_building_checks(spark):
    for bad in (np.arange(3), np.ones((2, 2), np.float16), [[1, 2], [3]], np.ma.masked_array([[1]], [[True]])):
        with pytest.raises((ValueError, TypeError)):
            dense_from_numpy(spark, bad)
    args = (np.array([1.5, 2.5]), [1, 1], [0, 2], (1, 3))
    with pytest.raises(ValueError, match="duplicate"):
        csr_from_arrays(spark, *args)
    assert csr_from_arrays(spark, *args, sum_duplicates=True).to_numpy().tolist() == [[0, 4, 0]]
    for data, indices, indptr in (([1], [5], [0, 1]), ([1], [0], [0, 2]), ([1], [0], [1, 1]), ([1, 2], [0], [0, 1])):
        with pytest.raises(ValueError):
            csr_from_arrays(spark, np.array(data), np.array(indices), np.array(indptr), (1, 3))


def test_helpers(grid, monkeypatch):
    m, a = grid
    monkeypatch.setattr(matrix, "BUCKET", 3)
    assert [r.value for r in m.indptr().orderBy("i").collect()] == INDPTR
    assert [b.shape for b in m.iter_batches(3)] == [(3, 9), (3, 9), (2, 9)]
    assert len(list(m.iter_rows())) == 8 and m.info()["nnz"] == 15 and m.index_dtype == "u16"
    np.testing.assert_array_equal(m.read_rows(2, 4).to_numpy(), a[2:4])
    np.testing.assert_array_equal(np.asarray(m.to_memory()), a)
    wide = csr_from_arrays(m.spark, np.array([5, 6]), [0, 99], [0, 1, 2], (2, 100))
    assert wide.to_numpy().sum() == 11 and wide.to_numpy()[1, 99] == 6
    with pytest.raises(ValueError):
        m.read_rows(5, 3)


def test_names(spark):
    assert names.build_feature_map(list("baca"), list("adc")) == (None, 0, 2, None)
    frame = lambda l: spark.createDataFrame(list(enumerate(l)), "pos long, name string")  # noqa: E731, E741
    got = names.feature_map(frame("baca"), frame("adc")).orderBy("src_col").collect()
    assert [r.out_col for r in got] == [None, 0, 2, None]
    assert names.locate_names(["c0", "c1", "c2"], ["c2", "c0"]).tolist() == [2, 0]
    assert names.locate_names(["c0", "c1"], ["c9", "c1"], missing="drop").tolist() == [1]
    with pytest.raises(ValueError):
        names.locate_names(["a"], ["b"])
    with pytest.raises(Exception, match="not present"):
        names.locate(frame("ab"), frame("ax")).collect()
    with pytest.raises(TypeError):
        names.as_str_tuple("abc")


def test_partition(spark):
    assert partition.budget_groups([4, 8, 0], 8) == [(0, 1), (1, 3)] and partition.budget_groups([12], 8) == [(0, 1)] and partition.budget_groups([], 8) == []
    costs = [3, 3, 3, 9, 0, 1, 8, 8, 2, 20, 1]
    rows = spark.createDataFrame(list(enumerate(costs)), "row long, cost long").repartition(4)
    got = [r.grp for r in partition.bytes_budget(rows, 9).orderBy("row").collect()]
    want = [g for g, (a, b) in enumerate(partition.budget_groups(costs, 9)) for _ in range(a, b)]
    assert got == want
    assert partition.dense_cells(10, 4, 100) == 3 and partition.dense_cells(10, 4, 1) == 1


def test_tools_slice():
    a = np.arange(12).reshape(4, 3)
    assert tools.slice(a)[[3, 0], ::-1].tolist() == [[11, 10, 9], [2, 1, 0]] and tools.slice(a)[1, 2] == 5 and tools.slice(a)[1].tolist() == [3, 4, 5]
    with pytest.raises(TypeError):
        tools.slice(np.arange(3))
    with pytest.raises(ValueError):
        tools.slice(a, num_workers=0)


def test_budget_groups_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(partition, "BUCKET_ROWS", 7)
    monkeypatch.setattr(partition, "SPAN", 3)
    rng = np.random.default_rng(5)
    for budget in (1, 9, 40, 1000):
        costs = rng.choice([0, 0, 1, 2, 3, 8, 20, 60], 150).tolist()
        rows = spark.createDataFrame(list(enumerate(costs)), "row long, cost long")
        got = [r.grp for r in partition.bytes_budget(rows, budget).orderBy("row").collect()]
        assert got == [g for g, (a, b) in enumerate(partition.budget_groups(costs, budget)) for _ in range(a, b)], budget


def test_exits_compose():
    rng = np.random.default_rng(6)
    for _ in range(200):
        costs = rng.choice([0, 0, 1, 2, 3, 5, 8, 20], rng.integers(1, 40))
        budget = int(rng.integers(1, 15))
        cuts = np.sort(rng.integers(0, len(costs), 3))
        runs = [partition.Exits.of(c, budget) for c in np.split(costs, cuts) if len(c)]
        whole = partition.Exits.of(costs, budget)
        left = runs[0]
        for e in runs[1:]:
            left = left.then(e)
        right = runs[-1]
        for e in runs[-2::-1]:
            right = e.then(right)
        for used in range(budget + 2):
            want = [int(x[0]) for x in whole.enter(np.array([used]))]
            assert all([int(x[0]) for x in e.enter(np.array([used]))] == want for e in (left, right))


def test_entries_equal_rows(spark):
    rng = np.random.default_rng(2)
    given = list(zip(rng.integers(0, 8, 60).tolist(), rng.integers(0, 9, 60).tolist(), rng.integers(1, 9, 60).astype(float).tolist()))
    a = np.zeros((8, 9))
    for r, c, v in given:
        a[r, c] += v
    e = matrix.EntryFrame(spark.createDataFrame(given, "row long, col int, value double"), 8, 9, matrix.dtype("f64"))
    for r in ROWS:
        for c in COLS:
            cols = np.array(c, np.int64) if isinstance(c, list) else c
            np.testing.assert_array_equal(e.select(r, c).to_numpy(), a[r][:, cols])
    csr = e.to_csr()
    assert e.nnz == csr.nnz == (a != 0).sum() and e.index_dtype == "u16"
    assert [x.value for x in e.indptr().orderBy("i").collect()] == [x.value for x in csr.indptr().orderBy("i").collect()] == [0, *np.cumsum((a != 0).sum(1))]
    plan = e.select(None, slice(2, 4)).to_csr().frame._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Filter") > plan.index("Exchange")  # columns go before the shuffle: below it in the plan
    assert "partial_sum" in plan


def test_dense_parts_are_bounded(spark, monkeypatch):
    rows = [(i, [i % 70, 70 + i % 30], [1.0, 2.0]) for i in range(300)]
    m = matrix.CsrFrame(spark.createDataFrame(rows, "row long, indices array<int>, values array<double>"), 300, 100, matrix.dtype("f64"))
    want = m.to_numpy()
    assert want.sum() == 900 and matrix.CELLS // 100 > 0
    batches = list(m.iter_batches(64))
    assert [b.shape for b in batches] == [(64, 100)] * 4 + [(44, 100)]
    np.testing.assert_array_equal(np.concatenate([b.to_numpy() for b in batches]), want)
