"""Matrix stores: Parquet files of rows sorted by row, and a description of them.

A store is a folder: the marker ``_CURRENT-<n>-gen-<id>`` with the largest n names the generation in use,
``gen-<id>/_meta.json`` describes it and ``gen-<id>/data`` holds its rows. Writers add a generation and then a
marker, so a reader always finds a whole store and keeps its snapshot, and a failed write changes nothing.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.errors import InvalidMetaError, ResourceLimitError, warn_slow  # type: ignore[attr-defined]
from ..functions.types import dtype
from ..operators.matrix import CsrFrame, DenseFrame, Matrix, csr_from_arrays, csr_schema, dense_from_numpy, dense_schema, index_faults
from ..operators.partition import bytes_budget
from .fs import Files
from .options import DEFAULT_READ_LIMITS, DEFAULT_WRITE_OPTIONS, Codec, ReadLimits, WriteOptions

FORMAT, VERSION = "matrixloom", 2
META = "_meta.json"
#: Chunks whose first rows the driver keeps to cut files at exact budgets (8 bytes each); more are cut at about equal rows.
EXACT_CHUNKS = 1_000_000


class Store:
    """An open matrix: a lazy matrix, its description, and the generation it is pinned to."""

    def __init__(self, files: Files, generation: str, meta: dict, matrix: Matrix, limits: ReadLimits):
        self.files, self.generation, self.meta, self._matrix, self.limits, self.closed = files, generation, meta, matrix, limits, False

    @property
    def matrix(self) -> Matrix:
        if self.closed:
            raise ValueError("the store is closed")
        return self._matrix

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.matrix, name)

    def __getitem__(self, key: Any):
        return self.matrix[key]

    def to_numpy(self) -> np.ndarray:
        n, m = self.matrix.shape
        if n * m * self.matrix.dtype.itemsize > self.limits.max_decoded_size:
            raise ResourceLimitError(f"{n} x {m} values exceed max_decoded_size; select less or read batches")
        return self.matrix.to_numpy()

    toarray = todense = to_numpy

    def __array__(self, dtype: Any = None, copy: Any = None) -> np.ndarray:
        return self.matrix.__array__(dtype)

    def __len__(self) -> int:
        return self.meta["shape"][0]

    @property
    def path(self) -> str:
        return self.files.root

    @property
    def codec(self) -> Codec:
        return Codec(**self.meta["codec"])

    @property
    def indptr_codec(self) -> Codec | None:
        return Codec(**self.meta["indptr_codec"]) if "indptr_codec" in self.meta else None

    def copy(self) -> Store:
        return Store(self.files, self.generation, self.meta, self.matrix, self.limits)

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    def info(self) -> dict:
        return {**self.meta, "path": self.path, "generation": self.generation}

    def manifest(self) -> str:
        """Names the exact contents: description and data files."""
        listed = self.files.list(f"{self.generation}/data")
        return hashlib.sha256(json.dumps([self.meta, [(n, s) for n, _, s in listed if n.startswith("part-")]], sort_keys=True).encode()).hexdigest()


def _by_budget(frame, costs, budget: int):
    """frame dealt so that a file holds the whole rows of one greedy group of costs; None if there are too many groups."""
    firsts = bytes_budget(costs, budget).groupBy("grp").agg(F.min("row").alias("row"))
    got = sorted(r.row for r in firsts.select("row").limit(EXACT_CHUNKS + 1).collect())
    if len(got) > EXACT_CHUNKS:
        return None, None
    bounds = np.array(got[1:], np.int64)

    @F.pandas_udf("int")
    def group(row):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, row.to_numpy(), side="right").astype(np.int32))

    return frame.repartitionById(max(1, len(got)), group("row")).sortWithinPartitions("row"), max(1, len(got))


def _write(matrix: Matrix, path: str, options: WriteOptions, overwrite: bool) -> Store:
    files = Files(matrix.spark, path)
    d, frame, codec = matrix.dtype, matrix.frame, options.resolved_codec()
    if idle := codec.unused():
        warn_slow(f"Parquet's {codec.backend} knows no {' and '.join(idle)}; kept in the description only")
    with files.new("gen", overwrite) as generation:
        chunk_rows, block_rows = options.dense_rows(matrix.n_cols, d.itemsize)
        writer_options = codec.parquet_options()
        if matrix.kind == "csr":
            sized = frame.agg(F.coalesce(F.sum(F.size("indices")), F.lit(0)).alias("nnz"), F.max(F.array_max("indices")).alias("top"), F.sum(index_faults(F.col("indices"), matrix.n_cols)).alias("faults"))
            got = sized.first()
            if got.faults:
                raise ValueError("column indices must ascend strictly within bounds")
            nnz, index_dtype = int(got.nnz), "u16" if got.top is None or got.top < 1 << 16 else "u32"
            cost = max(int(index_dtype[1:]) // 8, d.itemsize)
            of_row = nnz * cost / max(matrix.n_rows, 1)
            block_rows = options.block_cells or max(1, int((options.block_budget or 1) // max(of_row, 1)))
            ordered = None
            if options.chunk_policy == "cells":
                parts = -(-matrix.n_rows // options.chunk_cells)
                ordered = frame.repartitionById(max(1, parts), F.expr(f"cast(row div {options.chunk_cells} as int)")).sortWithinPartitions("row") if parts <= EXACT_CHUNKS else None
            elif nnz * cost > (options.chunk_budget or 1):
                ordered, parts = _by_budget(frame, frame.select("row", (F.size("indices") * cost).alias("cost")), options.chunk_budget or 1)
            else:
                parts = 1
            parts = parts or int(nnz * cost // (options.chunk_budget or 1)) + 1
            extra, partition = {"nnz": nnz, "index_dtype": index_dtype}, {"chunks": int(parts), "block_rows": block_rows}
        else:
            parts, extra, ordered, partition = -(-matrix.n_rows // chunk_rows), {}, None, {"chunk_rows": chunk_rows, "block_rows": block_rows}
            if 1 < parts <= EXACT_CHUNKS:
                ordered = frame.repartitionById(int(parts), F.expr(f"cast(row div {chunk_rows} as int)")).sortWithinPartitions("row")
        if ordered is None:  # by ranges of about equal rows, so that a range of rows touches few files
            ordered = frame.repartitionByRange(int(parts), "row").sortWithinPartitions("row") if parts > 1 else frame.coalesce(1).sortWithinPartitions("row")
        if options.block_policy == "cells":
            writer_options["parquet.block.row.count.limit"] = str(options.block_cells)
        elif options.block_budget:
            writer_options["parquet.page.size"] = str(max(options.block_budget, 4096))
        ordered.write.options(**writer_options).parquet(files.at(f"{generation}/data"))
        meta = {"format": FORMAT, "version": VERSION, "kind": matrix.kind, "shape": list(matrix.shape), "dtype": d.name, **extra, "codec": vars(codec), "partition": partition}
        if matrix.kind == "csr" and options.indptr_codec:
            meta["indptr_codec"] = vars(options.indptr_codec)
        files.write(f"{generation}/{META}", json.dumps(meta, sort_keys=True))
    return open_store(matrix.spark, path, generation=generation)


def write_dense(spark: SparkSession, array: Any, path: str, *, options: WriteOptions | None = None, overwrite: bool = False, indptr_codec: Any = None, **knobs: Any) -> Store:
    if indptr_codec is not None:
        raise ValueError("a dense matrix has no row pointers to compress")
    matrix = array if isinstance(array, DenseFrame) else dense_from_numpy(spark, array)
    return _write(matrix, path, (options or DEFAULT_WRITE_OPTIONS).with_overrides(**knobs), overwrite)


def write_csr(spark: SparkSession, matrix: Any, path: str, *, options: WriteOptions | None = None, overwrite: bool = False, **knobs: Any) -> Store:
    """A CsrFrame, or anything with data, indices, indptr and shape; duplicate coordinates are summed."""
    if not isinstance(matrix, CsrFrame):
        matrix = csr_from_arrays(spark, matrix.data, matrix.indices, matrix.indptr, matrix.shape, sum_duplicates=True)
    return _write(matrix, path, (options or DEFAULT_WRITE_OPTIONS).with_overrides(**knobs), overwrite)


def write_csr_arrays(spark: SparkSession, data: Any, indices: Any, indptr: Any, shape: tuple[int, int], path: str, *, options: WriteOptions | None = None, overwrite: bool = False, **knobs: Any) -> Store:
    """Raw buffers; duplicate coordinates are refused."""
    return _write(csr_from_arrays(spark, data, indices, indptr, shape), path, (options or DEFAULT_WRITE_OPTIONS).with_overrides(**knobs), overwrite)


def write(spark: SparkSession, matrix: Any, path: str, **knobs: Any) -> Store:
    """Sparse things as sparse, all others as dense."""
    sparse = isinstance(matrix, CsrFrame) or all(hasattr(matrix, a) for a in ("indptr", "indices", "data"))
    return (write_csr if sparse else write_dense)(spark, matrix, path, **knobs)


def read_meta(files: Files, generation: str, limits: ReadLimits) -> dict:
    name = f"{generation}/{META}"
    if files.size(name) > limits.max_metadata_size:
        raise ResourceLimitError(f"the description of {files.root} is larger than {limits.max_metadata_size} bytes")
    try:
        meta = json.loads(files.read(name))
        shape = meta["shape"]
        good = meta["format"] == FORMAT and meta["version"] == VERSION and meta["kind"] in ("dense", "csr") and len(shape) == 2 and all(isinstance(x, int) and x >= 0 for x in shape)
        dtype(meta["dtype"])
        Codec(**meta["codec"])
        blocks = -(-shape[0] // meta["partition"]["block_rows"])
        good = good and (meta["kind"] == "dense" or isinstance(meta["nnz"], int) and meta["index_dtype"] in ("u16", "u32") and (shape[1] or not meta["nnz"]))
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidMetaError(f"{files.root}: {e}") from e
    if not good:
        raise InvalidMetaError(f"{files.root}: not a store of this format")
    if blocks > limits.max_block_count:
        raise ResourceLimitError(f"{files.root} declares {blocks} blocks; max_block_count is {limits.max_block_count}")
    return meta


def open_store(spark: SparkSession, path: str, *, zip_prefix: str | None = None, limits: ReadLimits | None = None, generation: str | None = None, **overrides: Any) -> Store:
    """A store by its folder or its place in a ZIP archive, pinned to its current generation.

    A folder or archive with one store inside opens that one; with several they are named in the error. Keywords
    named as limits replace those of `limits`.
    """
    from .zipio import is_archive, unpacked

    limits = (limits or DEFAULT_READ_LIMITS).with_overrides(**overrides)
    if is_archive(spark, path):
        return open_store(spark, unpacked(spark, path, zip_prefix), limits=limits)
    if zip_prefix is not None:
        raise ValueError(f"{path} is no archive, so it has no prefixes")
    files = Files(spark, path)
    generation = generation or files.current()
    if generation is None:
        inside = [n for n, folder, _ in files.list() if folder and files.inside(n).current()]
        if len(inside) == 1:
            return open_store(spark, files.at(inside[0]), limits=limits)
        if inside:
            raise ValueError(f"{path} holds several stores: {inside}")
        raise FileNotFoundError(path)
    meta = read_meta(files, generation, limits)
    largest = max((size for _, _, size in files.list(f"{generation}/data")), default=0)
    if largest > limits.max_encoded_size:
        raise ResourceLimitError(f"a file of {path} has {largest} bytes; max_encoded_size is {limits.max_encoded_size}")
    d, (n_rows, n_cols) = dtype(meta["dtype"]), meta["shape"]
    schema = dense_schema(d) if meta["kind"] == "dense" else csr_schema(d)
    frame = spark.read.schema(schema).parquet(files.at(f"{generation}/data"))
    extra = {k: meta[k] for k in ("nnz", "index_dtype") if k in meta}
    matrix = (DenseFrame if meta["kind"] == "dense" else CsrFrame)(frame, n_rows, n_cols, d, extra)
    return Store(files, generation, meta, matrix, limits)


def _open_kind(kind: str):
    def opened(spark: SparkSession, path: str, **how: Any) -> Store:
        store = open_store(spark, path, **how)
        if store.meta["kind"] != kind:
            raise ValueError(f"{path} is {store.meta['kind']}, not {kind}")
        return store

    opened.__doc__ = f"open_store for {kind} matrices only."
    return opened


open_dense, open_csr = _open_kind("dense"), _open_kind("csr")


def expire(store: Store) -> list[str]:
    """Deletes all generations but the current one; readers of old ones lose them."""
    old = store.files.expire()
    if old:
        warn_slow(f"{len(old)} generations were deleted; sessions pinned to them fail")
    return old
