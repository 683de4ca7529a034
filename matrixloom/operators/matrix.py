"""Matrices as DataFrames: dense (row, values), compressed sparse rows (row, indices, values), or entries (row, col, value).

Selections are lazy plans. Rows are found by pushed-down ranges where arithmetic allows and by an equi-join
otherwise; columns are array expressions, so neither needs a shuffle of the cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import int_array, let
from ..functions.types import DType, dtype
from .axis import AxisSpec, normalize_axis, normalize_key

#: Columns from which densifying goes through numpy in Arrow batches instead of map lookups.
WIDE = 64
#: Rows of a bucket in which running sums are taken at once.
BUCKET = 1 << 16
#: Cells that a worker makes dense at once (some 100 MB).
CELLS = 1 << 22
#: Batches that one task packs for the driver.
BATCHES = 16


def dense_schema(d: DType) -> T.StructType:
    return T.StructType([T.StructField("row", T.LongType(), False), T.StructField("values", T.ArrayType(d.spark, False), False, {"dtype": d.name})])


def csr_schema(d: DType) -> T.StructType:
    return T.StructType([T.StructField("row", T.LongType(), False), T.StructField("indices", T.ArrayType(T.IntegerType(), False), False), T.StructField("values", T.ArrayType(d.spark, False), False, {"dtype": d.name})])


@dataclass(frozen=True)
class Matrix:
    """frame holds one record per row 0..n_rows-1; a sparse matrix may leave empty rows out."""

    frame: DataFrame
    n_rows: int
    n_cols: int
    dtype: DType
    meta: dict = field(default_factory=dict, compare=False)
    #: The matrix itself where the driver has it already.
    local: np.ndarray | None = field(default=None, compare=False, repr=False)

    kind = ""
    ndim = 2

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_rows, self.n_cols

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    # --- selection ---

    def _rows(self, spec: AxisSpec) -> DataFrame:
        row = F.col("row")
        frame = self.frame if (p := spec.predicate(row)) is None else self.frame.where(p)
        at = spec.place(row)
        if at is not None:
            return frame.withColumn("row", at)
        request = spec.request(self.spark)
        return frame.join(request, "row").drop("row").withColumnRenamed("pos", "row").select(*self.frame.columns)

    def select(self, rows: Any = None, cols: Any = None) -> Matrix:
        """Rows and columns by any keys; order and duplicates are kept on both axes."""
        r, c = normalize_axis(rows, self.n_rows, "row")[0], normalize_axis(cols, self.n_cols, "col")[0]
        frame = self._rows(r)
        if c.kind != "all":
            frame = self._columns(frame, c)
        return replace(self, frame=frame, n_rows=r.length, n_cols=c.length, meta={}, local=None)

    def _columns(self, frame: DataFrame, spec: AxisSpec) -> DataFrame:
        raise NotImplementedError

    def gather(self, request: DataFrame, n_rows: int | None = None) -> Matrix:
        """Rows by a table (pos, row) of any size; positions run from 0."""
        n = request.count() if n_rows is None else n_rows
        frame = self.frame.join(request.select("row", "pos"), "row").drop("row").withColumnRenamed("pos", "row").select(*self.frame.columns)
        return replace(self, frame=frame, n_rows=n, meta={}, local=None)

    def keep(self, rows: DataFrame) -> Matrix:
        """Rows whose number is in a table (row), in ascending order and numbered anew; the relational form of a mask."""
        return self.gather(renumber(rows.select("row").distinct()))

    def __getitem__(self, key: Any):
        """numpy-like: a dense scalar row drops its axis, a sparse one stays a matrix, two scalars give a value."""
        r, c, one_row, one_col = normalize_key(key, self.n_rows, self.n_cols)
        out = self.select(r, c)
        if one_row and one_col:
            return out.to_numpy()[0, 0]
        if self.kind == "dense" and (one_row or one_col):
            return out.to_numpy()[0] if one_row else out.to_numpy()[:, 0]
        return out

    # --- results on the driver ---

    def to_numpy(self) -> np.ndarray:
        """The whole matrix on the driver; meant for selections that fit there."""
        if self.local is not None:
            return self.local
        got = self.to_dense().frame.select("row", "values").toArrow()
        out = np.zeros(self.shape, self.dtype.numpy)
        if got.num_rows and self.n_cols:
            flat = got["values"].combine_chunks().flatten()
            flat = np.array([int(v) for v in flat.to_pylist()], np.uint64) if self.dtype.name == "u64" else flat.to_numpy(zero_copy_only=False)
            out[got["row"].to_numpy()] = flat.reshape(got.num_rows, self.n_cols).astype(self.dtype.numpy)
        return out

    toarray = todense = to_numpy

    def __array__(self, dtype: Any = None, copy: Any = None) -> np.ndarray:
        out = self.to_numpy()
        return out if dtype is None else out.astype(dtype)

    def read(self) -> Matrix:
        return self

    def read_rows(self, start: int, stop: int) -> Matrix:
        if not 0 <= start <= stop <= self.n_rows:
            raise ValueError(f"row range {start}:{stop} is not within 0:{self.n_rows}")
        return self.select(slice(start, stop))

    def batches(self, batch_rows: int = 1024) -> DataFrame:
        """(batch_id, first_row, n_rows, data): each batch's dense cells as bytes, batches in order of partitions; one shuffle of rows."""
        if batch_rows < 1:
            raise ValueError("batch_rows must be at least 1")
        rows = self.to_dense().frame.select(F.expr(f"row div {batch_rows}").alias("batch_id"), F.col("row").alias("pos"), "values")
        packed = packed_batches(rows, -(-self.n_rows // batch_rows), self.dtype, self.n_cols)
        return packed.select("batch_id", (F.col("batch_id") * batch_rows).alias("first_row"), F.col("n").alias("n_rows"), "data")

    def iter_batches(self, batch_rows: int = 1024) -> Iterator[DenseFrame]:
        """Batches of rows in order, already on the driver; one job streams them, BATCHES a task."""
        dense = self.to_dense()
        for b in self.batches(batch_rows).toLocalIterator(prefetchPartitions=True):
            array = np.frombuffer(b.data, self.dtype.numpy).reshape(b.n_rows, self.n_cols)
            yield replace(dense.select(slice(b.first_row, b.first_row + b.n_rows)), local=array)

    def iter_rows(self) -> Iterator[np.ndarray]:
        for batch in self.iter_batches():
            yield from batch.to_numpy()

    def to_memory(self) -> Matrix:
        """The same matrix from rows held by the session's block manager."""
        return replace(self, frame=self.frame.cache())

    def to_dense(self) -> DenseFrame:
        raise NotImplementedError

    def info(self) -> dict:
        return {"kind": self.kind, "shape": self.shape, "dtype": self.dtype.name, "nnz": None, **self.meta}


@dataclass(frozen=True)
class DenseFrame(Matrix):
    kind = "dense"

    def _columns(self, frame: DataFrame, spec: AxisSpec) -> DataFrame:
        if spec.kind == "range":
            picked = F.slice("values", spec.payload[0] + 1, spec.length) if spec.length else F.slice("values", 1, 0)
        else:
            picked = let(F.col("values"), lambda v: F.transform(int_array(spec.positions()), lambda c: F.get(v, c)))
        return frame.withColumn("values", picked)

    def to_dense(self) -> DenseFrame:
        return self

    def coo(self) -> DataFrame:
        """(row, col, value) of every cell."""
        return self.frame.select("row", F.posexplode("values").alias("col", "value"))


@dataclass(frozen=True)
class CsrFrame(Matrix):
    kind = "csr"

    def _summary(self) -> dict:
        """Entries and index type, in one pass where the store does not tell."""
        if not {"nnz", "index_dtype"} <= self.meta.keys():
            got = self.frame.agg(F.coalesce(F.sum(F.size("indices")), F.lit(0)).cast("long"), F.max(F.array_max("indices"))).first()
            self.meta.update(nnz=got[0], index_dtype="u16" if got[1] is None or got[1] < 1 << 16 else "u32")
        return self.meta

    @property
    def nnz(self) -> int:
        return self.meta["nnz"] if "nnz" in self.meta else self._summary()["nnz"]

    @property
    def index_dtype(self) -> str:
        """u16 where all column indices fit (and for no entries), else u32."""
        return self._summary()["index_dtype"]

    def _columns(self, frame: DataFrame, spec: AxisSpec) -> DataFrame:
        entries = F.arrays_zip("indices", "values")
        if spec.kind == "range":
            a = spec.payload[0]
            kept = F.filter(entries, lambda e: (e["indices"] >= a) & (e["indices"] < a + spec.length))
            pairs = F.transform(kept, lambda e: F.struct((e["indices"] - a).alias("o"), e["values"].alias("v")))
        else:
            # outputs of source column c are targets[offsets[c]:offsets[c + 1]], ascending
            p = spec.positions()
            targets = np.argsort(p, kind="stable")
            offsets = np.searchsorted(p[targets], np.arange(self.n_cols + 1))

            def outputs(e: Column, off: Column, to: Column) -> Column:
                a = F.get(off, e["indices"])
                return F.transform(F.slice(to, a + 1, F.get(off, e["indices"] + 1) - a), lambda o: F.struct(o.alias("o"), e["values"].alias("v")))

            pairs = F.array_sort(F.flatten(F.transform(entries, lambda e: outputs(e, int_array(offsets), int_array(targets)))))
        return frame.withColumn("__pairs", pairs).withColumn("indices", F.transform("__pairs", lambda x: x["o"])).withColumn("values", F.transform("__pairs", lambda x: x["v"])).drop("__pairs")

    def coo(self) -> DataFrame:
        """(row, col, value) of the stored entries."""
        return self.frame.select("row", F.explode(F.arrays_zip("indices", "values")).alias("e")).select("row", F.col("e.indices").alias("col"), F.col("e.values").alias("value"))

    def to_dense(self) -> DenseFrame:
        """Absent entries become 0; rows that are not stored come back too."""
        rows = self.spark.range(self.n_rows).withColumnRenamed("id", "row")
        frame = rows.join(self.frame, "row", "left")
        zero = self.dtype.literal(0)
        if self.n_cols > WIDE:
            frame = densify(frame, "row", self.n_cols, self.dtype, zeros(self.n_cols))
        else:
            empty = F.array().cast(f"array<{self.dtype.spark.simpleString()}>")
            kept = let(F.map_from_arrays(F.coalesce("indices", F.array().cast("array<int>")), F.coalesce("values", empty)), lambda m: F.transform(int_array(range(self.n_cols)), lambda c: F.coalesce(F.element_at(m, c), zero)))
            frame = frame.select("row", kept.alias("values"))
        return DenseFrame(frame, self.n_rows, self.n_cols, self.dtype)

    def indptr(self) -> DataFrame:
        """(i, value): the n_rows + 1 running totals of stored entries."""
        return running_totals(self.frame.select("row", F.size("indices").cast("long").alias("n")), self.n_rows)

    def tocsr(self):
        """(data, indices, indptr) arrays on the driver, or a scipy matrix where scipy is installed."""
        got = self.frame.orderBy("row").select("row", "indices", "values").toArrow()
        sizes = np.zeros(self.n_rows, np.int64)
        lists = got["indices"].combine_chunks()
        sizes[got["row"].to_numpy()] = [len(x) for x in lists.to_pylist()]
        flat = got["values"].combine_chunks().flatten()
        data = np.array([int(v) for v in flat.to_pylist()], np.uint64) if self.dtype.name == "u64" else flat.to_numpy(zero_copy_only=False).astype(self.dtype.numpy)
        return data, lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])

    def to_scipy(self):
        try:
            from scipy.sparse import csr_matrix
        except ImportError as e:
            raise ImportError("scipy is not installed; tocsr() gives the arrays") from e
        return csr_matrix(self.tocsr(), shape=self.shape)

    def info(self) -> dict:
        return super().info() | {"nnz": self.nnz}


def running_totals(counted: DataFrame, n_rows: int) -> DataFrame:
    """(i, value) for i from 0 to n_rows: sums of n over the rows (row, n) before i; by bucket sums and windows inside buckets."""
    from pyspark.sql import Window

    spark = counted.sparkSession
    rows = spark.range(n_rows).withColumnRenamed("id", "row")
    sized = rows.join(counted, "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"), F.expr(f"row div {BUCKET}").alias("bucket"))
    # of the counted rows alone: a row without entries adds nothing, and before an empty bucket the last total holds
    sums = counted.groupBy(F.expr(f"row div {BUCKET}").alias("bucket")).agg(F.sum("n").alias("s"))
    buckets = spark.range(-(-n_rows // BUCKET)).withColumnRenamed("id", "bucket").join(sums, "bucket", "left")
    before = buckets.select("bucket", F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ends = sized.withColumn("value", F.sum("n").over(inside)).join(F.broadcast(before) if n_rows < BUCKET << 20 else before, "bucket").select((F.col("row") + 1).alias("i"), (F.col("value") + F.col("before")).alias("value"))
    return spark.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("value")).unionByName(ends)


def packed_batches(rows: DataFrame, n_batches: int, d: DType, n_cols: int) -> DataFrame:
    """(batch_id, n, data) of (batch_id, pos, values), each batch's rows by pos as bytes; partitions hold BATCHES batches, in order."""
    import pyarrow as pa

    kind, u64 = d.numpy, d.name == "u64"

    def cells(lists: list[pa.Array]) -> bytes:
        flat = pa.concat_arrays(lists)
        return np.ascontiguousarray(np.array([int(v) for v in flat.to_pylist()], np.uint64) if u64 else flat.to_numpy(zero_copy_only=False).astype(kind)).tobytes()

    def run(batches):
        number, n, held = None, 0, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([n], pa.int64()), pa.array([cells(held)], pa.binary())], names=["batch_id", "n", "data"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(ids)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if a == b:
                    continue
                if ids[a] != number:
                    if held:
                        yield done()
                    number, n, held = int(ids[a]), 0, []
                held.append(batch.column(1).slice(a, b - a).flatten())
                n += int(b - a)
        if held:
            yield done()

    parts = max(1, -(-n_batches // BATCHES))
    dealt = rows.repartitionById(parts, F.expr(f"cast(batch_id div {BATCHES} as int)")).sortWithinPartitions("batch_id", "pos")
    return dealt.select("batch_id", "values").mapInArrow(run, "batch_id long, n long, data binary")


def zeros(n: int) -> list:
    return [0] * n


def densify(frame: DataFrame, key: str, n_cols: int, d: DType, template: list, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., values): template rows with values put at indices, by one Arrow take for CELLS cells; any value type."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    columns = (key, *keep)
    schema = T.StructType([frame.schema[c] for c in columns] + [T.StructField("values", T.ArrayType(d.spark, True))])
    kind = to_arrow_type(d.spark)
    if d.name == "u64":
        from decimal import Decimal

        template = [Decimal(v) for v in template]

    rows = max(1, CELLS // max(n_cols, 1))

    def run(batches):
        base = pa.array(template, kind)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                n = batch.num_rows
                at = np.tile(np.arange(n_cols), (n, 1))
                indices, values = batch.column("indices"), batch.column("values")
                sizes = np.array(indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                flat_at, flat = indices.flatten().to_numpy(zero_copy_only=False), values.flatten()
                at[np.repeat(np.arange(n), sizes), flat_at] = n_cols + np.arange(len(flat_at))
                picked = pa.concat_arrays([base, flat.cast(kind)]).take(pa.array(at.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_cols), picked)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), lists], names=[*columns, "values"])

    return frame.select(*columns, "indices", "values").mapInArrow(run, schema)


def storable(array: Any) -> np.ndarray:
    """An array widened to the nearest value type: bool and u8 to u16, i8 to i16, f16 to f32, any byte order to the machine's."""
    a = np.asarray(array)
    wider = {"b1": np.uint16, "u1": np.uint16, "i1": np.int16, "f2": np.float32}.get(f"{a.dtype.kind}{a.dtype.itemsize}")
    return a.astype(wider) if wider is not None else a.astype(dtype(a.dtype).numpy)


# --- building matrices -----------------------------------------------------------------------


def canonical_rows(coo: DataFrame, value: str = "value") -> DataFrame:
    """(row, indices, values) of (row, col, value) entries: duplicate coordinates are summed, columns ascend.

    Sums combine before they are shuffled, by coordinate, so a row with very many entries is spread until it holds one
    entry a column; then rows are gathered.
    """
    kind = coo.schema[value].dataType
    summed = coo.groupBy("row", F.col("col").cast("int").alias("c")).agg(F.sum(value).cast(kind).alias("v"))
    rows = summed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("e"))
    return rows.select(F.col("row").cast("long").alias("row"), F.transform("e", lambda x: x["c"]).alias("indices"), F.transform("e", lambda x: x["v"]).alias("values"))


@dataclass(frozen=True)
class EntryFrame(Matrix):
    """A sparse matrix as entries (row, col, value) in any order; equal coordinates count as their sum.

    Selections and counts work on the entries, before any grouping; to_csr() gathers them into rows.
    """

    kind = "csr"

    def _columns(self, frame: DataFrame, spec: AxisSpec) -> DataFrame:
        if spec.kind != "positions":
            predicate = spec.predicate(F.col("col"))
            frame = frame if predicate is None else frame.where(predicate)
            return frame.withColumn("col", spec.place(F.col("col")).cast("int"))
        p = spec.positions()
        targets = np.argsort(p, kind="stable")
        offsets = int_array(np.searchsorted(p[targets], np.arange(int(p.max()) + 2)))
        first = F.get(offsets, F.col("col"))
        outputs = F.slice(int_array(targets), first + 1, F.get(offsets, F.col("col") + 1) - first)
        wanted = frame.where(spec.predicate(F.col("col"))).withColumn("__to", outputs).where(F.size("__to") > 0)
        return wanted.withColumn("col", F.explode("__to")).drop("__to")

    def counts(self) -> DataFrame:
        """(row, n, top) of the rows with entries: how many columns they have and the last of them; one shuffle, combined before."""
        of_row = self.frame.groupBy(F.col("row").cast("long").alias("row")).agg(F.collect_set("col").alias("cols"))
        return of_row.select("row", F.size("cols").cast("long").alias("n"), F.array_max("cols").alias("top"))

    def _summary(self) -> dict:
        if "nnz" not in self.meta:
            got = self.counts().agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("top")).first()
            self.meta.update(nnz=got[0], index_dtype="u16" if got[1] is None or got[1] < 1 << 16 else "u32")
        return self.meta

    @property
    def nnz(self) -> int:
        return self._summary()["nnz"]

    @property
    def index_dtype(self) -> str:
        return self._summary()["index_dtype"]

    def to_csr(self) -> CsrFrame:
        return CsrFrame(canonical_rows(self.frame), self.n_rows, self.n_cols, self.dtype)

    def to_dense(self) -> DenseFrame:
        return self.to_csr().to_dense()

    def coo(self) -> DataFrame:
        kind = self.frame.schema["value"].dataType
        return self.frame.groupBy("row", "col").agg(F.sum("value").cast(kind).alias("value"))

    def indptr(self) -> DataFrame:
        """Running totals of entries, from counts per row alone."""
        return running_totals(self.counts().select("row", "n"), self.n_rows)

    def info(self) -> dict:
        return super().info() | {"nnz": self.nnz}


def duplicate_coordinates(coo: DataFrame) -> DataFrame:
    """(row, col, n) of coordinates given more than once; writers of raw buffers reject them."""
    return coo.groupBy("row", "col").agg(F.count("*").alias("n")).where("n > 1")


def index_faults(indices: Column, n_cols: int) -> Column:
    """How many neighbours do not ascend strictly, plus indices out of bounds."""
    steps = F.zip_with(F.slice(indices, 1, F.greatest(F.size(indices) - 1, F.lit(0))), F.slice(indices, 2, F.greatest(F.size(indices) - 1, F.lit(0))), lambda a, b: (a >= b).cast("int"))
    outside = F.transform(indices, lambda i: ((i < 0) | (i >= n_cols)).cast("int"))
    return F.aggregate(F.concat(steps, outside), F.lit(0), lambda a, x: a + x)


def checked_indices(indices: Column, n_cols: int) -> Column:
    """indices, or a failing job if they do not ascend within bounds."""
    return F.when(index_faults(indices, n_cols) == 0, indices).otherwise(F.raise_error(F.lit("[decode] column indices must ascend strictly within bounds")).cast("array<int>"))


def dense_from_numpy(spark: SparkSession, array: Any) -> DenseFrame:
    """A dense matrix of a two-dimensional numeric array."""
    import pyarrow as pa

    if isinstance(array, np.ma.MaskedArray):
        raise ValueError("masked arrays are not supported")
    try:
        a = np.asarray(array)
    except ValueError as e:
        raise ValueError("rows must have equal lengths") from e
    if a.ndim != 2:
        raise ValueError(f"expected two dimensions, got {a.ndim}")
    d = dtype(a.dtype)
    a = np.ascontiguousarray(a.astype(d.numpy))
    schema = dense_schema(d)
    if d.name == "u64":
        from decimal import Decimal

        rows = [(i, [Decimal(int(v)) for v in r]) for i, r in enumerate(a)]
        return DenseFrame(spark.createDataFrame(rows, schema), *a.shape, d)
    from pyspark.sql.pandas.types import to_arrow_type

    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()).cast(to_arrow_type(d.spark)))
    frame = spark.createDataFrame(pa.table({"row": pa.array(np.arange(len(a))), "values": lists}), schema)
    return DenseFrame(frame, *a.shape, d)


def csr_from_arrays(spark: SparkSession, data: Any, indices: Any, indptr: Any, shape: tuple[int, int], *, sum_duplicates: bool = False) -> CsrFrame:
    """A sparse matrix of raw buffers. Structure is checked; columns are sorted; duplicates are summed or rejected."""
    data, indices, indptr = np.asarray(data), np.asarray(indices), np.asarray(indptr)
    n_rows, n_cols = (int(x) for x in shape)
    d = dtype(data.dtype)
    if min(data.ndim, indices.ndim, indptr.ndim) != 1 or max(data.ndim, indices.ndim, indptr.ndim) != 1:
        raise ValueError("buffers must have one dimension")
    if len(indptr) != n_rows + 1 or (len(indptr) and indptr[0] != 0) or (np.diff(indptr.astype(np.int64)) < 0).any():
        raise ValueError("indptr must have n_rows + 1 entries, start at 0 and not fall")
    if len(data) != len(indices) or int(indptr[-1]) != len(data):
        raise ValueError("data, indices and indptr disagree about the number of entries")
    if len(indices) and (indices.dtype.kind not in "iu" or int(indices.min()) < 0 or int(indices.max()) >= n_cols):
        raise ValueError("column indices are out of bounds")
    row = np.repeat(np.arange(n_rows), np.diff(indptr.astype(np.int64)))
    order = np.lexsort((indices, row))
    row, col, val = row[order], indices[order].astype(np.int64), data[order]
    same = (np.diff(row) == 0) & (np.diff(col) == 0)
    if same.any():
        if not sum_duplicates:
            raise ValueError("duplicate column indices in a row")
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        row, col, val = row[first], col[first], np.add.reduceat(val, first).astype(data.dtype)
    starts = np.searchsorted(row, np.arange(n_rows + 1))
    as_list = (lambda a: [__import__("decimal").Decimal(int(v)) for v in a]) if d.name == "u64" else (lambda a: a.tolist())
    rows = [(i, col[a:b].tolist(), as_list(val[a:b])) for i, (a, b) in enumerate(zip(starts[:-1], starts[1:]))]
    return CsrFrame(spark.createDataFrame(rows, csr_schema(d)), n_rows, n_cols, d, {"nnz": len(val)})


def renumber(frame: DataFrame, key: str = "row") -> DataFrame:
    """frame with `pos`, the rank of each distinct key from 0, by bucket counts and windows inside buckets."""
    from pyspark.sql import Window

    bucketed = frame.withColumn("__bucket", F.expr(f"{key} div {BUCKET}"))
    counts = bucketed.groupBy("__bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("__before", F.sum("n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))).select("__bucket", F.coalesce("__before", F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__bucket").orderBy(key)
    ranked = bucketed.withColumn("__n", F.row_number().over(inside) - 1).join(before, "__bucket")
    return ranked.withColumn("pos", F.col("__n") + F.col("__before")).drop("__n", "__before", "__bucket")
