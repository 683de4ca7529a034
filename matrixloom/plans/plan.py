"""Plans: an ordered request of rows of several sources, as a lazy DataFrame of dense output rows.

Rows are found by an equi-join of the request with each source. A dense source's columns are picked by one
array expression; a sparse source's entries are mapped to output columns first, converted, and put over a
template row by Arrow takes. Only mapped values are converted, so only they can overflow.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import ResourceLimitError  # type: ignore[attr-defined]
from ..functions.exprs import int_array, let
from ..functions.types import check_promotion, convert
from ..operators.matrix import Matrix, checked_indices, densify
from ..sources.container import Dataset, RowRef, register
from ..sources.options import as_int
from .config import IoMergeConfig, PlanConfig
from .output import OutputSpec

MAGIC, IMAGE_VERSION, MAX_IMAGE = b"MLPLAN01", 1, 2 << 30


def normalize_rows(rows: Any, n_sources: int, n_rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(source ids, rows) of a request: integers for one source, pairs or RowRefs for any number."""
    if isinstance(rows, np.ndarray):
        a = rows
    else:
        listed = [(r.source_id, r.row) if isinstance(r, RowRef) else r for r in rows]
        a = np.array(listed) if listed else np.empty((0,), np.int64)
    if a.dtype == np.bool_ or a.size and a.dtype.kind not in "iu":
        raise TypeError("rows must be integers, pairs of integers or RowRefs")
    if a.ndim == 1:
        if n_sources > 1 and a.size:
            raise TypeError("rows of several sources are given as (source_id, row) pairs")
        source, row = np.zeros(len(a), np.int64), a.astype(np.int64)
    elif a.ndim == 2 and a.shape[1] == 2:
        source, row = a[:, 0].astype(np.int64), a[:, 1].astype(np.int64)
    else:
        raise ValueError("rows must have the form (n,) or (n, 2)")
    if (source < 0).any() or (row < 0).any():
        raise ValueError("rows must not be negative")
    if (source >= n_sources).any():
        raise ValueError(f"source_id {int(source.max())} of {n_sources} sources")
    for s, n in enumerate(n_rows):
        if (row[source == s] >= n).any():
            raise ValueError(f"row {int(row[source == s].max())} of source {s} with {n} rows")
    return source, row


def infer_output(sources: list[Dataset], output: OutputSpec | None) -> OutputSpec:
    if output is not None:
        return output
    if len(sources) != 1 or sources[0].feature_map is not None and sources[0].feature_map != tuple(range(sources[0].n_cols)):
        raise ValueError("output is needed with several sources or a feature map")
    return OutputSpec(sources[0].n_cols, sources[0].dtype)


def source_rows(matrix: Matrix, request: DataFrame, feature_map: tuple[int | None, ...] | None, output: OutputSpec) -> DataFrame:
    """(pos, values) of one source's part of a request (pos, row)."""
    d = output.dtype
    check_promotion(matrix.dtype, d, output.allow_float_rounding)
    conv = lambda v: convert(v, matrix.dtype, d, fill=output.fill, overflow=output.overflow, overflow_value=output.overflow_value, allow_float_rounding=output.allow_float_rounding)
    identity = feature_map is None or feature_map == tuple(range(output.n_cols))
    if feature_map is None and matrix.n_cols != output.n_cols:
        raise ValueError(f"{matrix.n_cols} columns without a feature map for {output.n_cols} output columns")
    targets = list(range(matrix.n_cols)) if feature_map is None else [-1 if t is None else t for t in feature_map]
    if any(t >= output.n_cols for t in targets):
        raise ValueError("a feature map target is beyond the output's columns")
    joined = request.join(matrix.frame, "row", "inner" if matrix.kind == "dense" else "left")
    if matrix.kind == "dense":
        if identity:
            values = F.transform("values", conv)
        else:
            inverse = [-1] * output.n_cols
            for c, t in enumerate(targets):
                if t >= 0:
                    inverse[t] = c
            values = let(F.col("values"), lambda v: F.transform(int_array(inverse), lambda c: F.when(c < 0, d.literal(output.fill)).otherwise(conv(F.get(v, c)))))
        return joined.select("pos", values.alias("values"))
    mapped = set(t for t in targets if t >= 0)
    template = [0 if identity or o in mapped else output.fill for o in range(output.n_cols)]
    checked = F.when(F.col("indices").isNotNull(), checked_indices(F.col("indices"), matrix.n_cols)).alias("indices")
    entries = F.arrays_zip(checked, "values")
    if not identity:
        entries = let(int_array(targets), lambda t: F.filter(F.transform(F.arrays_zip(checked, "values"), lambda e: F.struct(F.get(t, e["indices"]).alias("indices"), e["values"].alias("values"))), lambda e: e["indices"] >= 0))
    kept = joined.withColumn("__e", entries).select("pos", F.transform("__e", lambda e: e["indices"]).alias("indices"), F.transform("__e", lambda e: conv(e["values"])).alias("values"))
    return densify(kept, "pos", output.n_cols, d, template)


class Plan:
    """An immutable, reusable request. Image: magic, SHA-256, JSON; binds to its sources again on first use."""

    def __init__(self, spark: SparkSession, sources: list[Dataset] | None, template: dict[str, Any]):
        self.spark, self._sources, self.template = spark, sources, template
        self.output = OutputSpec.from_dict(template["output"])

    # --- shape ---

    batch_size = property(lambda self: self.template["batch_size"])
    prefetch_step = property(lambda self: self.template["prefetch_step"])
    n_rows = property(lambda self: self.template["n_rows"])
    n_cols = property(lambda self: self.output.n_cols)
    shape = property(lambda self: (self.n_rows, self.n_cols))
    dtype = property(lambda self: self.output.dtype.numpy)
    batch_count = property(lambda self: -(-self.n_rows // self.batch_size))
    nbytes = property(lambda self: self.n_rows * self.output.row_nbytes)
    row_stride_bytes = property(lambda self: self.output.row_stride_bytes)
    is_empty = property(lambda self: self.n_rows == 0)
    bound = property(lambda self: self._sources is not None)
    cache_capacity_bytes = property(lambda self: self.template["cache_capacity_bytes"])
    io_merge = property(lambda self: IoMergeConfig(**self.template["io_merge"]))

    def info(self) -> dict:
        return {"shape": self.shape, "batch_size": self.batch_size, "batch_count": self.batch_count, "prefetch_step": self.prefetch_step, "bound": self.bound, "output": self.output.as_dict()}

    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        get = lambda k: np.frombuffer(base64.b64decode(self.template[k]), "<i8")
        return get("source_ids"), get("rows")

    # --- the request as a DataFrame ---

    def request(self) -> DataFrame:
        import pyarrow as pa

        source, row = self._arrays()
        frame = self.spark.createDataFrame(pa.table({"pos": pa.array(np.arange(len(row))), "source_id": pa.array(source.astype(np.int32)), "row": pa.array(row)}))
        return frame.withColumn("batch_id", F.expr(f"pos div {self.batch_size}"))

    def frame(self, rank: int | None = None, world_size: int = 1) -> DataFrame:
        """(pos, batch_id, values), unordered; of one rank's batches where a rank is given."""
        request = self.request()
        if rank is not None:
            request = request.where(F.pmod("batch_id", F.lit(world_size)) == rank)
        used = set(self._arrays()[0].tolist())
        out = None
        for s, dataset in enumerate(self.sources):
            if s in used or s == 0:
                part = source_rows(dataset.matrix, request.where(F.col("source_id") == s).select("pos", "row"), dataset.feature_map, self.output)
                out = part if out is None else out.unionByName(part)
        return out.withColumn("batch_id", F.expr(f"pos div {self.batch_size}")).select("pos", "batch_id", "values")

    # --- running ---

    def open(self, config: Any = None, *, copy: bool = False):
        from ..streaming.session import Session

        return Session(self, config, copy=copy)

    def open_distributed(self, world_size: int, config: Any = None, *, spooled: bool = False):
        from ..streaming.session import DistributedSession

        return DistributedSession(self, world_size, config, spooled=spooled)

    def prefetch(self, config: Any = None, *, copy: bool = False):
        from ..streaming.session import Prefetch

        return Prefetch(self, config, copy=copy)

    def iter_batches(self, config: Any = None, *, copy: bool = False) -> Iterator[np.ndarray]:
        with self.open(config, copy=copy) as session:
            yield from session

    def read(self, config: Any = None) -> np.ndarray:
        with self.open(config) as session:
            return session.read()

    # --- sources ---

    @property
    def sources(self) -> list[Dataset]:
        if self._sources is None:
            self.bind()
        return self._sources

    def bind(self, *, sources: Mapping[int, str] | None = None, verify: str = "strict") -> Plan:
        """Opens the sources, elsewhere if told, and compares them with what the plan was compiled for."""
        if verify != "strict":
            raise ValueError("verify must be 'strict'")
        if self._sources is not None:
            if sources:
                raise ValueError("the plan is bound already")
            return self
        opened = []
        for i, s in enumerate(self.template["sources"]):
            path = (sources or {}).get(i, s["path"])
            if not os.path.isabs(path) and "://" not in path and self.template.get("_base"):
                path = os.path.join(self.template["_base"], path)
            dataset = register(self.spark, path, key=s["key"] or "X", feature_names=None, obs_names=None)
            if dataset.store.manifest() != s["manifest"]:
                raise ValueError(f"stale plan source {i}: {path} has changed")
            opened.append(replace(dataset, feature_map=None if s["feature_map"] is None else tuple(s["feature_map"])))
        self._sources = opened
        return self

    # --- images ---

    def dumps(self, *, relative_to: str | None = None) -> bytes:
        template = {k: v for k, v in self.template.items() if k != "_base"}
        if relative_to is not None:
            template["sources"] = [{**s, "path": os.path.relpath(s["path"], relative_to)} for s in template["sources"]]
        body = json.dumps({"version": IMAGE_VERSION, **template}, sort_keys=True).encode()
        if len(body) > MAX_IMAGE:
            raise ValueError("the plan is too large for an image")
        return MAGIC + hashlib.sha256(body).digest() + body

    @classmethod
    def loads(cls, image: bytes, spark: SparkSession | None = None, *, base: str | None = None) -> Plan:
        if len(image) > MAX_IMAGE + 40 or image[:8] != MAGIC or hashlib.sha256(image[40:]).digest() != image[8:40]:
            raise ValueError("not a whole plan image")
        template = json.loads(image[40:])
        if template.pop("version") != IMAGE_VERSION:
            raise ValueError("plan image of another version")
        return cls(spark or SparkSession.getActiveSession(), None, {**template, "_base": base})

    def save(self, path: str, *, relative_sources: bool = False) -> None:
        beside = f"{path}.writing"
        with open(beside, "wb") as f:
            f.write(self.dumps(relative_to=os.path.dirname(os.path.abspath(path)) if relative_sources else None))
        os.replace(beside, path)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Plan:
        with open(path, "rb") as f:
            return cls.loads(f.read(MAX_IMAGE + 41), spark, base=os.path.dirname(os.path.abspath(path)))

    def __reduce__(self):
        return Plan.loads, (self.dumps(),)

    @property
    def stats(self):
        from .stats import plan_stats

        return plan_stats(self)


def compile(datasets: Dataset | Iterable[Dataset], rows: Any, *, output: OutputSpec | None = None, batch_size: int = 256, prefetch_step: int = 8, config: PlanConfig | None = None) -> Plan:  # noqa: A001
    """Checks a request completely and makes its plan; no data is read but for the sources' descriptions."""
    sources = [datasets] if isinstance(datasets, Dataset) else list(datasets)
    if not sources or not all(isinstance(s, Dataset) for s in sources):
        raise TypeError("compile takes a Dataset or several")
    output, config = infer_output(sources, output), config or PlanConfig()
    batch_size, prefetch_step = as_int(batch_size, "batch_size", 1), as_int(prefetch_step, "prefetch_step", 1)
    source_ids, row_ids = normalize_rows(rows, len(sources), [s.n_rows for s in sources])
    spark = sources[0].matrix.spark
    for s in sources:
        check_promotion(s.dtype, output.dtype, output.allow_float_rounding)
        width = s.n_cols if s.feature_map is None else max([-1, *(t for t in s.feature_map if t is not None)]) + 1
        if width > output.n_cols or s.feature_map is None and s.n_cols != output.n_cols:
            raise ValueError(f"{s.key or s.path} does not fit {output.n_cols} output columns")
    batches = -(-len(row_ids) // batch_size)
    if min(len(row_ids), batch_size) > config.limits.max_cells_per_job:
        raise ResourceLimitError(f"a batch of {min(len(row_ids), batch_size)} rows exceeds max_cells_per_job")
    ring = output.row_stride_bytes * batch_size * min(prefetch_step, max(batches, 1))
    if ring > config.limits.max_output_buffer_bytes:
        raise ResourceLimitError(f"output buffers of {ring} bytes exceed max_output_buffer_bytes")
    pack = lambda a: base64.b64encode(np.ascontiguousarray(a, "<i8").tobytes()).decode()
    described = [{"path": s.path, "key": s.key, "manifest": s.store.manifest(), "feature_map": None if s.feature_map is None else list(s.feature_map), "partition": s.store.meta.get("partition", {}), "kind": s.kind} for s in sources]
    template = {
        "output": output.as_dict(), "batch_size": batch_size, "prefetch_step": prefetch_step, "n_rows": len(row_ids), "sources": described,
        "source_ids": pack(source_ids), "rows": pack(row_ids), "cache_capacity_bytes": config.cache_capacity_bytes, "output_ring_bytes": ring, "io_merge": vars(config.io_merge),
    }
    return Plan(spark, sources, template)


def planned(datasets: Dataset | Iterable[Dataset], request: DataFrame, *, output: OutputSpec | None = None, batch_size: int = 256, rank: int | None = None, world_size: int = 1) -> DataFrame:
    """(pos, batch_id, values) of a request that is itself a table (pos, source_id, row) of any size; of one rank's batches where a rank is given.

    Nothing of the request comes to the driver. A row that a source does not have fails the job.
    """
    sources = [datasets] if isinstance(datasets, Dataset) else list(datasets)
    output, batch_size = infer_output(sources, output), as_int(batch_size, "batch_size", 1)
    if rank is not None:
        request = request.where(F.expr(f"pos div {batch_size} % {as_int(world_size, 'world_size', 1)} = {as_int(rank, 'rank', 0, world_size - 1)}"))
    sizes = int_array([s.n_rows for s in sources], "bigint")
    known = F.get(sizes, F.col("source_id").cast("int"))
    wrong = F.raise_error(F.concat_ws(" ", F.lit("[corrupt] no row"), F.col("row").cast("string"), F.lit("in source"), F.col("source_id").cast("string"))).cast("long")
    checked = request.withColumn("row", F.when((F.col("row") >= 0) & (F.col("row") < F.coalesce(known, F.lit(0))), F.col("row").cast("long")).otherwise(wrong))
    # rows of no source are checked with the first source's
    own = [F.col("source_id") == i for i in range(len(sources))]
    own[0] = ~F.col("source_id").isin(list(range(1, len(sources)))) if len(sources) > 1 else F.lit(True)
    parts = [source_rows(s.matrix, checked.where(mine).select(F.col("pos").cast("long").alias("pos"), "row"), s.feature_map, output) for s, mine in zip(sources, own)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("batch_id", F.expr(f"pos div {batch_size}")).select("pos", "batch_id", "values")


def prefetch(datasets: Any, rows: Any, *, output: OutputSpec | None = None, batch_size: int = 256, prefetch_step: int = 8, plan_config: PlanConfig | None = None, config: Any = None, copy: bool = False):
    """Compiles and returns the lazy iterator over batches."""
    return compile(datasets, rows, output=output, batch_size=batch_size, prefetch_step=prefetch_step, config=plan_config).prefetch(config, copy=copy)


def distributed_prefetch(datasets: Any, rows: Any, world_size: int, *, output: OutputSpec | None = None, batch_size: int = 256, prefetch_step: int = 8, plan_config: PlanConfig | None = None, config: Any = None):
    return compile(datasets, rows, output=output, batch_size=batch_size, prefetch_step=prefetch_step, config=plan_config).open_distributed(world_size, config)
