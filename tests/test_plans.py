import pickle
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import matrixloom as ml
from matrixloom.functions import errors
from matrixloom.plans import plan as plans
from matrixloom.plans import stats
from matrixloom.sources import container, store, zipio

X = np.arange(12, dtype=np.float32).reshape(4, 3)


def put(spark, path, matrix, **how):
    ml.write(spark, matrix, str(path), **how).close()
    return ml.register(spark, str(path))


@pytest.fixture
def dense(spark, tmp_path):
    return put(spark, tmp_path / "d", X)


def sparse(spark, path):
    return put(spark, path, ml.csr_from_arrays(spark, np.array([1, 2, 3, 4, -5], np.int16), [0, 3, 1, 4, 2], [0, 2, 2, 4, 5], (4, 5)))


def test_dense_map_and_fill(dense):
    d = dense.with_feature_map([2, None, 0])
    plan = ml.compile(d, [3, 1, 0], output=ml.OutputSpec(4, np.float32, fill=-1), batch_size=2)
    a, b = list(plan.open())
    assert a.tolist() == [[11, -1, 9, -1], [5, -1, 3, -1]] and b.tolist() == [[2, -1, 0, -1]]
    assert not a.flags.writeable and next(iter(plan.open(copy=True))).flags.writeable
    assert (plan.shape, plan.batch_count, plan.nbytes, plan.row_stride_bytes, plan.dtype) == ((3, 4), 2, 48, 64, np.float32)


def test_sparse_map_fill_and_widening(spark, tmp_path):
    d = sparse(spark, tmp_path / "s").with_feature_map([4, 1, None, 0, 3])
    got = ml.compile(d, [1, 2, 0, 3], output=ml.OutputSpec(6, "i32", fill=-9)).read()
    assert got.tolist() == [[0, 0, -9, 0, 0, -9], [0, 3, -9, 4, 0, -9], [2, 0, -9, 0, 1, -9], [0, 0, -9, 0, 0, -9]]
    narrow = d.with_feature_map([0, 1, None, 2, 3])
    assert ml.compile(narrow, [3], output=ml.OutputSpec(4, "u16")).read().tolist() == [[0, 0, 0, 0]]  # -5 has no place, so it cannot overflow


def test_interleaved_sources(spark, tmp_path):
    a = put(spark, tmp_path / "a", np.array([[1, 2, 3, 4], [5, 6, 7, 8]], np.int32))
    b = put(spark, tmp_path / "b", ml.csr_from_arrays(spark, np.array([10, 40, 20, 30], np.int32), [0, 3, 1, 2], [0, 2, 4], (2, 4)))
    rows = [(1, 1), (0, 0), ml.RowRef(1, 0)]
    got = ml.compile([a, b], rows, output=ml.OutputSpec(4, "i64")).read()
    assert got.tolist() == [[0, 20, 30, 0], [1, 2, 3, 4], [10, 0, 0, 40]]


def test_conversions_and_errors_while_running(spark, tmp_path):
    d = put(spark, tmp_path / "i", np.array([[-3, 4], [5, 6]], np.int16))
    spec = lambda **k: ml.OutputSpec(2, "u16", **k)
    assert ml.compile(d, [0, 1], output=spec(overflow="use_value", overflow_value=777)).read().tolist() == [[777, 4], [5, 6]]
    assert ml.compile(d, [0], output=spec(overflow="use_fill", fill=99)).read().tolist() == [[99, 4]]
    session = ml.compile(d, [0, 1], output=spec()).open()
    with pytest.raises(errors.SessionError) as e:
        next(session)
    assert isinstance(e.value.__cause__, errors.ConversionError) and session.state == "failed"
    with pytest.raises(errors.PromotionError):
        ml.compile(put(spark, tmp_path / "f", X), [0], output=ml.OutputSpec(3, "i32"))
    big = put(spark, tmp_path / "u", np.array([[0, 2**63 + 1]], np.uint64))
    assert ml.compile(big, [0], output=ml.OutputSpec(2, "i64", overflow="use_fill", fill=-99)).read().tolist() == [[0, -99]]
    assert ml.compile(big, [0]).read().tolist() == [[0, 2**63 + 1]]


def test_compile_checks(dense, spark, tmp_path):
    other = put(spark, tmp_path / "o", X)
    for args, error in (
        ((dense, [4]), ValueError), ((dense, [-1]), ValueError), ((dense, [0.5]), TypeError), ((dense, [(1, 0)]), ValueError), (([dense, other], [(0, 0)]), ValueError),
    ):
        with pytest.raises(error):
            ml.compile(*args)
    with pytest.raises(TypeError):
        ml.compile([dense, other], [0, 1], output=ml.OutputSpec(3, "f32"))
    for bad in ([0, 0, 1], [0, 1], [-1, 0, 1]):
        with pytest.raises(ValueError):
            dense.with_feature_map(bad)
    with pytest.raises(ValueError):
        ml.compile(dense.with_feature_map([0, 1, 9]), [0], output=ml.OutputSpec(4, "f32"))
    with pytest.raises(errors.ResourceLimitError):
        ml.compile(dense, [0] * 9, config=ml.PlanConfig(limits=ml.ResourceLimits(max_cells_per_job=4)))
    with pytest.raises(errors.ResourceLimitError):
        ml.compile(dense, [0], config=ml.PlanConfig(limits=ml.ResourceLimits(max_output_buffer_bytes=100)))
    for bad in (dict(overflow="use_value"), dict(overflow="x"), dict(overflow_value=1), dict(fill="a")):
        with pytest.raises((ValueError, TypeError)):
            ml.OutputSpec(2, "u16", **bad)
    assert ml.compile(dense, []).read().shape == (0, 3) and ml.compile(dense, []).is_empty


def test_names_align(spark, tmp_path):
    write_sample(spark, tmp_path / "c")
    d = ml.register(spark, str(tmp_path / "c"))
    assert d.feature_names == ("g0", "g1", "g2") and d.obs_names == ("c0", "c1", "c2", "c3")
    d = d.with_aligned_features(["g2", "g0", "extra"])
    assert d.feature_map == (1, None, 0)
    got = ml.compile(d, d.rows_for(["c3", "c1"]), output=ml.OutputSpec(3, "f32", fill=-1)).read()
    assert got.tolist() == [[11, 9, -1], [5, 3, -1]]


def test_ranks(spark, tmp_path):
    d = put(spark, tmp_path / "r", np.arange(24, dtype=np.float32).reshape(8, 3))
    plan = ml.compile(d, range(8), batch_size=2)
    with plan.open_distributed(2) as s:
        first, second = s.ranks()
        second = pickle.loads(pickle.dumps(second))
        assert [int(r[0]) // 3 for b in first for r in b] == [0, 1, 4, 5] and [int(r[0]) // 3 for b in second for r in b] == [2, 3, 6, 7]
        assert len(first) == 2
        with pytest.raises(ValueError):
            s.rank(0)
        with pytest.raises(TypeError):
            pickle.dumps(first)
    assert sorted(r.pos for r in plan.frame(1, 3).collect()) == [2, 3]
    with plan.open_distributed(3, spooled=True) as s:
        got = [[int(r[0]) // 3 for b in it for r in b] for it in s.ranks()]
        assert got == [[0, 1, 6, 7], [2, 3], [4, 5]] and s._source
    assert s._source is None


def test_sessions(dense):
    plan = ml.compile(dense, [0, 1, 2, 3, 0], batch_size=2)
    s = plan.open()
    assert len(s) == 3 and next(s).shape == (2, 3) and s.read().shape == (3, 3)
    assert s.stats.as_dict() == {"state": "finished", "rows_yielded": 5, "batches_yielded": 3, "bytes_yielded": 60} and s.progress == 1.0
    s = plan.open()
    s.cancel()
    with pytest.raises(errors.CancelledError):
        next(s)
    p = plan.prefetch()
    assert p.state == "unopened" and next(p).shape == (2, 3) and p.state == "running"
    p.close()
    p.close()
    assert list(p) == [] and sum(len(b) for b in ml.prefetch(dense, [1, 2], batch_size=1)) == 2
    assert plan.stats.input_rows == 5 and plan.stats.jobs == 3 and plan.stats.output_ring_bytes == 64 * 2 * 3


def test_images(dense, spark, tmp_path):
    plan = ml.compile(dense, [2, 0])
    image = plan.dumps()
    again = ml.Plan.loads(image, spark)
    assert not again.bound and again.read().tolist() == plan.read().tolist() and again.bound
    with pytest.raises(ValueError):
        again.bind(sources={0: "x"})
    with pytest.raises(ValueError):
        ml.Plan.loads(image[:-1] + b"x", spark)
    plan.save(str(tmp_path / "p"), relative_sources=True)
    assert ml.Plan.load(str(tmp_path / "p"), spark).read().tolist() == plan.read().tolist()
    assert pickle.loads(pickle.dumps(plan)).shape == plan.shape
    ml.write_dense(spark, X + 1, dense.path, overwrite=True)
    with pytest.raises(ValueError, match="stale"):
        ml.Plan.loads(image, spark).bind()
    assert plan.read().tolist() == [[6, 7, 8], [0, 1, 2]]  # the open plan keeps its generation


def test_store_writes(spark, tmp_path):
    path = str(tmp_path / "w")
    s = ml.write_dense(spark, X, path, codec="blosc", chunk_policy="cells", chunk_cells=2, block_policy="cells", block_cells=1)
    assert s.meta["partition"] == {"chunk_rows": 2, "block_rows": 1} and s.shape == (4, 3) and s[1].tolist() == [3, 4, 5]
    with pytest.raises(FileExistsError):
        ml.write_dense(spark, X, path)
    old = ml.open_store(spark, path)
    ml.write_dense(spark, X * 2, path, overwrite=True)
    assert old.to_numpy().tolist() == X.tolist() and ml.open_store(spark, path).to_numpy().tolist() == (X * 2).tolist()
    assert len(store.expire(ml.open_store(spark, path))) == 1
    old.close()
    with pytest.raises(ValueError):
        old.to_numpy()
    (tmp_path / "junk").mkdir()
    (tmp_path / "junk/x").write_text("y")
    with pytest.raises(FileExistsError):
        ml.write_dense(spark, X, str(tmp_path / "junk"))
    with pytest.raises(ValueError):
        ml.write_dense(spark, X, str(tmp_path / "z"), indptr_codec="zstd")
    with pytest.raises(errors.ResourceLimitError):
        ml.open_store(spark, path, limits=ml.ReadLimits(max_metadata_size=3))
    with pytest.raises(FileNotFoundError):
        ml.open_store(spark, str(tmp_path / "none"))
    c = ml.write_csr_arrays(spark, np.array([5, 6], np.uint16), [2, 0], [0, 1, 2], (2, 3), str(tmp_path / "c"))
    assert c.info()["index_dtype"] == "u16" and c.nnz == 2 and c.to_numpy().tolist() == [[0, 0, 5], [6, 0, 0]]


def test_options():
    assert ml.Codec.parse("zstd").level == 3 and ml.Codec.parse({"algorithm": "blosc", "backend": "zstd"}).parquet_options()["compression"] == "zstd"
    assert ml.Codec.parse(" BLOSC ") == ml.Codec.blosc() and ml.Codec.parse(ml.Codec.zstd(1)) == ml.Codec("zstd", level=1) == ml.Codec.parse({"algorithm": "zstd", "level": 1})
    assert ml.Codec.blosc("zlib", 9).parquet_options()["zlib.compress.level"] == "BEST_COMPRESSION" and ml.Codec.blosc(level=5).unused() == [] and ml.Codec.blosc(level=9, shuffle="bits").unused() == ["level", "shuffle"]
    for wrong in (3, None, {"algorithm": "blosc", "split_blocks": "false"}, {"algorithm": "zlib", "level": True}):
        with pytest.raises(TypeError):
            ml.Codec.parse(wrong)
    for bad in ({"algorithm": "zstd", "shuffle": "bits"}, {"algorithm": "blosc", "level": 10}, "snappy", {"x": 1}, {"algorithm": "lz4", "level": 1}, {"algorithm": "zstd", "level": 10**12}, {"level": 1}, {"algorithm": "none", "level": 1}):
        with pytest.raises(ValueError):
            ml.Codec.parse(bad)
    for bad in (dict(num_workers=0), dict(queue_depth=1), dict(io_mode="x"), dict(max_total_inflight_io_ops=1)):
        with pytest.raises(ValueError):
            ml.SessionConfig(**bad)
    for bad in (dict(cache_alignment=96), dict(cache_capacity_bytes=0)):
        with pytest.raises(ValueError):
            ml.PlanConfig(**bad)
    assert ml.IoMergeConfig(max_io_gap_bytes=5).max_io_gap_bytes == 0 and "spark.sql.files.maxPartitionBytes" in ml.IoMergeConfig(policy="cost").spark_conf()


def write_sample(spark, path, **how):
    obs = spark.createDataFrame([(i, f"c{i}", "ab"[i % 2]) for i in range(4)], "pos long, name string, batch string")
    var = spark.createDataFrame([(i, f"g{i}") for i in range(3)], "pos long, name string")
    cube = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    return ml.write_container(spark, str(path), obs=obs, var=var, matrices={"X": X, "layers/counts": X + 1, "obsm/cube": cube, "obsp/near": np.eye(4)}, uns={"a": [1]}, **how)


def test_container(spark, tmp_path):
    path, seen = tmp_path / "c", []
    assert write_sample(spark, path, progress=lambda *a: seen.append(a)) == ["X", "layers/counts", "obsm/cube", "obsp/near"] and len(seen) == 6
    assert ml.list_keys(spark, str(path)) == ["X", "layers/counts", "obsm/cube", "obsp/near"]
    c = ml.read_container(spark, str(path), exclude=["obsp"])
    assert sorted(c.matrices) == ["X", "layers/counts", "obsm/cube"] and c.uns == {"a": [1]} and c.obs.count() == 4
    np.testing.assert_array_equal(c.array("obsm/cube"), np.arange(24, dtype=np.float32).reshape(2, 3, 4))
    assert sorted(ml.read_container(spark, str(path), include=["layers/counts"]).matrices) == ["layers/counts"]
    with pytest.raises(FileExistsError):
        write_sample(spark, path)
    write_sample(spark, path, overwrite=True)
    c = ml.read_container(spark, str(path))
    with pytest.raises(ValueError):
        ml.write_container(spark, str(tmp_path / "bad"), obs=c.obs, var=c.var, matrices={"Y": X})
    with pytest.raises(ValueError):
        ml.read_container(spark, str(path), include=["nothing"])
    assert not (tmp_path / "bad").exists()
    for bad in ("", "a/../b", "a\\b", "a//b"):
        with pytest.raises(ValueError):
            container.normalize_key(bad)
    d = pickle.loads(pickle.dumps(ml.register(spark, str(path), key="layers/counts")))
    assert d.shape == (4, 3) and d.matrix[0].tolist() == [1, 2, 3] and ml.read_feature_names(spark, str(path), "obsm/cube") is None


def test_zip(spark, tmp_path):
    put(spark, tmp_path / "d", X)
    archive = str(tmp_path / "a.zip")
    zipio.pack(str(tmp_path / "d"), archive, prefix="one")
    zipio.pack(str(tmp_path / "d"), archive, prefix="two")
    assert zipio.list_stores(archive) == ["one", "two"]
    with pytest.raises(FileExistsError):
        zipio.pack(str(tmp_path / "d"), archive, prefix="one")
    with pytest.raises(ValueError):
        zipio.unpack(archive, str(tmp_path / "out"))
    assert ml.open_store(spark, zipio.unpack(archive, str(tmp_path / "out"), prefix="two")).to_numpy().tolist() == X.tolist()
    with pytest.warns(errors.PerformanceWarning):
        zipio.pack(str(tmp_path / "d"), str(tmp_path / "b.zip"), compression=zipfile.ZIP_DEFLATED)
    (tmp_path / "d/link").symlink_to(tmp_path)
    with pytest.raises(ValueError):
        zipio.pack(str(tmp_path / "d"), str(tmp_path / "c.zip"))


def test_seeded_requests_against_numpy(spark, tmp_path):
    """Random access in several batch sizes equals fancy indexing."""
    a = np.arange(32 * 5, dtype=np.uint16).reshape(32, 5)
    d = put(spark, tmp_path / "d", a)
    rows, s = [], 0x9E3779B9
    for _ in range(96):
        s = (s * 1664525 + 1013904223) & 0xFFFFFFFF
        rows.append(s % 32)
    for size in (1, 4, 50):
        plan = ml.compile(d, np.array(rows), batch_size=size)
        assert [len(b) for b in plan.iter_batches()][:-1] == [size] * (plan.batch_count - 1)
        np.testing.assert_array_equal(plan.read(), a[rows])


def test_plan_is_lazy_and_joins_once(dense):
    text = plans.compile(dense, [3, 1]).frame()._jdf.queryExecution().executedPlan().toString()
    assert text.count("Join") == 1 and "CartesianProduct" not in text
    assert dense.matrix.frame.where(F.col("row") == 1).count() == 1


def test_requests_as_tables(spark, tmp_path, dense):
    other = sparse(spark, tmp_path / "s").with_feature_map([0, 1, None, 2, 3])
    rows = [(0, 0, 3), (1, 1, 2), (2, 0, 3), (3, 1, 1)]
    frame = spark.createDataFrame(rows, "pos long, source_id int, row long")
    first = dense.with_feature_map([2, None, 0])
    spec = ml.OutputSpec(4, "f32", fill=-1)
    got = [list(r["values"]) for r in ml.planned([first, other], frame, output=spec, batch_size=2).orderBy("pos").collect()]
    assert got == ml.compile([first, other], [(s, r) for _, s, r in rows], output=spec).read().tolist()
    for bad in ((0, 0, 9), (0, 7, 0), (0, 1, -1)):
        with pytest.raises(Exception, match="no row"):
            ml.planned([first, other], spark.createDataFrame([bad], frame.schema), output=spec).collect()


def test_rows_by_table_and_counts(spark, dense):
    m = dense.matrix
    picked = m.gather(spark.createDataFrame([(0, 3), (1, 0), (2, 3)], "pos long, row long"))
    assert picked.to_numpy().tolist() == X[[3, 0, 3]].tolist()
    assert m.keep(spark.createDataFrame([(3,), (1,), (3,)], "row long")).to_numpy().tolist() == X[[1, 3]].tolist()
    counts = ml.integerize_matrix(m)
    assert counts.dtype.name == "u16" and counts.to_numpy().tolist() == X.astype(int).tolist()
    with pytest.raises(errors.ConversionError):
        ml.integerize_matrix(ml.dense_from_numpy(spark, X - 0.5))
    assert ml.storable(np.array([True])).dtype == np.uint16 and ml.storable(np.array([1], ">f4")).dtype == np.float32 and ml.storable(np.array([1], np.int8)).dtype == np.int16
    with pytest.raises(ValueError):
        ml.open_csr(spark, dense.path)
    with pytest.raises(errors.ResourceLimitError):
        ml.open_dense(spark, dense.path, limits=ml.ReadLimits(max_decoded_size=10)).to_numpy()


def test_readers_find_whole_stores_while_one_is_replaced(spark, tmp_path):
    import threading

    path, seen, stop = str(tmp_path / "p"), [], threading.Event()
    ml.write_dense(spark, X, path).close()

    def poll():
        while not stop.is_set():
            seen.append(float(ml.open_store(spark, path).to_numpy().sum()))

    thread = threading.Thread(target=poll)
    thread.start()
    try:
        for k in range(2, 6):
            ml.write_dense(spark, X * k, path, overwrite=True).close()
    finally:
        stop.set()
        thread.join()
    assert seen and set(seen) <= {float((X * k).sum()) for k in range(1, 6)} and seen == sorted(seen)
    before = sorted(p.name for p in (tmp_path / "p").iterdir())
    with pytest.raises(Exception):
        ml.write_csr(spark, ml.CsrFrame(spark.createDataFrame([(0, [1, 0], [1.0, 2.0])], "row long, indices array<int>, values array<double>"), 1, 3, ml.dtype("f64")), path, overwrite=True)
    assert sorted(p.name for p in (tmp_path / "p").iterdir()) == before


def test_containers_are_replaced_whole(spark, tmp_path):
    path = tmp_path / "c"
    write_sample(spark, path)
    old = ml.read_container(spark, str(path))
    write_sample(spark, path, overwrite=True)
    assert old.matrices["X"].to_numpy().tolist() == X.tolist() and len(old.obs.collect()) == 4  # an open container keeps its version

    def occupy(name, index, total):
        if index == total:
            (tmp_path / "race/other").write_text("concurrent writer")

    with pytest.raises(FileExistsError):
        write_sample(spark, tmp_path / "race", progress=occupy)
    assert [p.name for p in (tmp_path / "race").iterdir() if not p.name.startswith(".")] == ["other"]
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine/thesis").write_text("x")
    with pytest.raises(FileExistsError):
        write_sample(spark, tmp_path / "mine", overwrite=True)
    assert (tmp_path / "mine/thesis").exists()
    obs, var = old.obs, old.var
    for matrices, error in (({"X": X, "layers/b": np.array([[True]] * 4)}, (ValueError, TypeError)), ({"X": X[:, :2]}, ValueError), ({"X": X[:3]}, ValueError)):
        with pytest.raises(error):
            ml.write_container(spark, str(tmp_path / "never"), obs=obs, var=var, matrices=matrices)
    assert not (tmp_path / "never").exists()
    table = obs.selectExpr("pos", "batch")
    ml.write_container(spark, str(tmp_path / "t"), obs=obs, var=var, matrices={"X": X}, tables={"obsm/kinds": table})
    assert ml.read_container(spark, str(tmp_path / "t")).tables["obsm/kinds"].count() == 4
    about = next((tmp_path / "t").glob("ver-*/_container.json"))
    about.write_text(about.read_text().replace('"version": 1', '"version": 9'))
    next((tmp_path / "t").glob("ver-*/._container.json.crc")).unlink()
    with pytest.raises(errors.UnsupportedError):
        ml.read_container(spark, str(tmp_path / "t"))


def test_archives_open_in_place(spark, tmp_path):
    put(spark, tmp_path / "d", X)
    write_sample(spark, tmp_path / "c")
    one, two, box = (str(tmp_path / n) for n in ("one.zip", "two.zip", "box.zip"))
    zipio.pack(str(tmp_path / "d"), one)
    zipio.pack(str(tmp_path / "d"), two, prefix="a")
    zipio.pack(str(tmp_path / "d"), two, prefix="b/c")
    container.pack_container(spark, str(tmp_path / "c"), box)
    assert ml.open_store(spark, one).to_numpy().tolist() == X.tolist()
    assert ml.open_store(spark, two, zip_prefix="b/c")[1].tolist() == [3, 4, 5] and zipio.list_stores(two) == ["a", "b/c"]
    with pytest.raises(ValueError, match="b/c"):
        ml.open_store(spark, two)
    with pytest.raises(FileNotFoundError):
        ml.open_store(spark, two, zip_prefix="z")
    with pytest.raises(ValueError):
        ml.open_store(spark, str(tmp_path / "d"), zip_prefix="a")
    (tmp_path / "no.zip").write_text("nothing of the kind")
    with pytest.raises(errors.ZipError):
        ml.open_store(spark, str(tmp_path / "no.zip"))
    assert ml.list_keys(spark, box) == ["X", "layers/counts", "obsm/cube", "obsp/near"]
    d = ml.register(spark, box, key="layers/counts").with_aligned_features(["g2", "no"])
    assert ml.compile(d, d.rows_for(["c3", "c0"]), output=ml.OutputSpec(2, "f32", fill=-1)).read().tolist() == [[12, -1], [3, -1]]
    assert ml.open_store(spark, box, zip_prefix="layers/counts").shape == (4, 3)
    assert ml.read_container(spark, box, include=["obsm"]).array("obsm/cube").shape == (2, 3, 4)


def test_write_knobs_act(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(1)
    a = rng.integers(0, 50, (4000, 40)).astype(np.int32)
    size = lambda p: sum(f.stat().st_size for f in p.glob("gen-*/data/part-*"))
    for level in (0, 9):
        ml.write_dense(spark, a, str(tmp_path / f"z{level}"), codec=ml.Codec.blosc("zstd", level))
        ml.write_dense(spark, a, str(tmp_path / f"g{level}"), codec=ml.Codec.blosc("zlib", level))
    assert size(tmp_path / "z9") < size(tmp_path / "z0") and size(tmp_path / "g9") < size(tmp_path / "g0")
    with pytest.warns(errors.PerformanceWarning, match="shuffle"):
        s = ml.write_dense(spark, a, str(tmp_path / "s"), codec=ml.Codec.blosc(shuffle="bytes"))
    assert s.codec == ml.Codec.blosc(shuffle="bytes")
    ml.write_dense(spark, a, str(tmp_path / "b"), chunk_policy="cells", chunk_cells=1000, block_policy="cells", block_cells=250)
    files = sorted((tmp_path / "b").glob("gen-*/data/part-*.parquet"))
    assert len(files) == 4 and all(pq.ParquetFile(f).metadata.num_row_groups >= 4 for f in files)
    indptr = np.concatenate([[0], np.cumsum(rng.integers(0, 9, 300))])
    cols = np.concatenate([rng.choice(70, n, replace=False) for n in np.diff(indptr)])
    c = ml.write_csr_arrays(spark, np.ones(len(cols), np.float32), cols, indptr, (300, 70), str(tmp_path / "c"), chunk_budget=200, indptr_codec="zstd")
    files = list((tmp_path / "c").glob("gen-*/data/part-*.parquet"))
    got = sorted((min(t), max(t)) for t in (pq.read_table(f)["row"].to_pylist() for f in files) if t)
    from matrixloom.operators.partition import budget_groups

    assert got == [(x, y - 1) for x, y in budget_groups((np.diff(indptr) * 4).tolist(), 200)] and c.indptr_codec == ml.Codec.zstd() and c.meta["partition"]["chunks"] == len(got)
    for limit in (dict(max_block_count=3), dict(max_encoded_size=10), dict(max_metadata_size=10)):
        with pytest.raises(errors.ResourceLimitError):
            ml.open_store(spark, str(tmp_path / "b"), **limit)
    assert ml.open_store(spark, str(tmp_path / "b"), limits=ml.ReadLimits(max_decoded_size=5), num_workers=4).limits.num_workers == 4
    for bad in (dict(max_decoded_size=True), dict(max_block_count=1 << 128), dict(num_workers=0)):
        with pytest.raises((TypeError, ValueError)):
            ml.ReadLimits(**bad)


def test_names_of_rows_stay_tables(spark, tmp_path):
    write_sample(spark, tmp_path / "c")
    d = ml.register(spark, str(tmp_path / "c"))
    assert d.given_names is None and d.observations.count() == 4
    wanted = spark.createDataFrame([(0, "c2"), (1, "c0"), (2, "c2")], "pos long, name string")
    rows = d.rows_for(wanted)
    assert sorted((r.pos, r.row) for r in rows.collect()) == [(0, 2), (1, 0), (2, 2)]
    assert [list(r["values"]) for r in ml.planned(d, rows.withColumn("source_id", F.lit(0)), batch_size=2, rank=1, world_size=2).collect()] == [X[2].tolist()]
    with pytest.raises(ValueError, match="c9"):
        d.rows_for(["c1", "c9"])
    assert d.rows_for(["c1", "c9"], missing="drop").tolist() == [1]
    assert ml.register(spark, str(tmp_path / "c"), obs_names=list("abcd")).rows_for(["c"]).tolist() == [2]


def test_broken_indices_fail_the_batch(spark, tmp_path):
    frame = spark.createDataFrame([(0, [2, 1], [1.0, 2.0])], "row long, indices array<int>, values array<double>")
    rows = plans.source_rows(ml.CsrFrame(frame, 1, 3, ml.dtype("f64")), spark.createDataFrame([(0, 0)], "pos long, row long"), None, ml.OutputSpec(3, "f64"))
    with pytest.raises(Exception, match="ascend"):
        rows.collect()


def test_counters_of_tables_and_arrays_agree(spark, tmp_path):
    a = np.arange(60, dtype=np.float32).reshape(30, 2)
    ml.write(spark, a, str(tmp_path / "d"), block_policy="cells", block_cells=4).close()
    d = ml.register(spark, str(tmp_path / "d"))
    rows = [(7 * i * i) % 30 for i in range(50)]
    plan = ml.compile(d, rows, batch_size=8)
    frame = spark.createDataFrame([(i, 0, r) for i, r in enumerate(rows)], "pos long, source_id int, row long")
    got = stats.request_stats(frame, [4], 8).first()
    want = plan.stats
    assert (got.input_rows, got.jobs, got.block_jobs, got.cache_reference_hits, got.cache_reference_misses) == (want.input_rows, want.jobs, want.block_jobs, want.cache_reference_hits, want.cache_reference_misses)
    assert want.data_io_ops == 8 and want.predicted_io_seconds > 0 and want.max_decoded_bytes_per_job <= 8 * 32 and len(want.as_dict()) > 40
    assert stats.request_stats(frame.limit(0), [4], 8).first().jobs == 0


def test_sessions_shuffle_rows_once(dense):
    from matrixloom.streaming.session import packed

    text = packed(plans.compile(dense, [3, 1]))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") <= 2 and "rangepartitioning" not in text  # the join's and the batches'
