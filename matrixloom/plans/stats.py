"""Counters of plans and sessions, under the interface's names. Those of a hand-made I/O scheduler do not exist here and are None."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import int_array


@dataclass(frozen=True)
class PlanStats:
    """Block counters follow a cache that never evicts: a block is missed once in each batch that no earlier batch read it in."""

    input_rows: int
    jobs: int
    block_jobs: int
    unique_cache_objects: int
    cache_reference_hits: int
    cache_reference_misses: int
    output_ring_bytes: int
    row_stride_bytes: int
    cache_capacity_bytes: int
    predicted_physical_bytes: int
    io_payload_bytes: int
    io_read_amplification: float | None
    data_io_ops: int = 0
    indices_io_ops: int = 0
    gap_bytes: int = 0
    io_span_bytes: int = 0
    predicted_io_seconds: float = 0.0
    max_decoded_bytes_per_job: int = 0
    residency_loads: int = 0
    residency_reloads: int = 0
    independent_block_loads: int = 0
    executable_tasks: int = 0
    compile_time_io_ops: int = 0
    compile_time_io_bytes: int = 0
    cache_horizon_max_batches: int = 0
    max_encoded_bytes_per_side: int | None = None
    arena_bytes: int | None = None
    compile_working_set_bytes: int | None = None
    retained_whole_key_bytes: int | None = None
    cache_arena_bytes: int | None = None
    cache_alignment_loss_bytes: int | None = None
    cache_capacity_stalls: int | None = None
    cache_fragmentation_stalls: int | None = None
    initialize_io_tasks: int | None = None
    dependency_edges: int | None = None
    fused_io_tasks: int | None = None
    predicted_io_ops_saved: int | None = None
    max_decode_ops_per_io_task: int | None = None
    max_decoded_bytes_per_io_task: int | None = None
    initialize_fused_io_tasks: int | None = None
    regular_fused_io_tasks: int | None = None

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class RuntimeStats:
    state: str
    rows_yielded: int
    batches_yielded: int
    bytes_yielded: int

    def as_dict(self) -> dict:
        return asdict(self)


def plan_stats(plan) -> PlanStats:
    source, row = plan._arrays()
    batch = np.arange(len(row)) // plan.batch_size
    block = np.zeros(len(row), np.int64)
    objects = sparse_blocks = physical = payload = meta_bytes = 0
    decoded = np.zeros(plan.batch_count, np.int64)
    for s, described in enumerate(plan.template["sources"]):
        mine = source == s
        size = described["partition"].get("block_rows") or 1
        block[mine] = row[mine] // size
        found = len(np.unique(block[mine]))
        csr = described["kind"] == "csr"
        objects += found * (2 if csr else 1)  # entries and their column indices
        sparse_blocks += found * csr
    if plan.bound:
        for s, dataset in enumerate(plan.sources):
            mine = source == s
            if mine.any():
                files = dataset.store.files
                data = sum(n for f, _, n in files.list(f"{dataset.store.generation}/data") if f.startswith("part-"))
                physical += data
                payload += data * len(np.unique(row[mine])) // max(dataset.n_rows, 1)
                meta_bytes += files.size(f"{dataset.store.generation}/_meta.json")
                size = dataset.store.meta["partition"].get("block_rows") or 1
                met = np.unique(np.stack([batch[mine], block[mine]]), axis=1)
                np.add.at(decoded, met[0], size * dataset.n_cols * dataset.dtype.itemsize)
    references = np.unique(np.stack([batch, source, block]), axis=1).shape[1] if len(row) else 0
    blocks = np.unique(np.stack([source, block]), axis=1).shape[1] if len(row) else 0
    horizon = 0
    if len(row):
        _, at = np.unique(np.stack([source, block]), axis=1, return_inverse=True)
        first, last = np.full(blocks, len(row)), np.zeros(blocks, np.int64)
        np.minimum.at(first, at.ravel(), batch)
        np.maximum.at(last, at.ravel(), batch)
        horizon = int((last - first).max()) + 1
    merge = plan.io_merge
    return PlanStats(
        len(row), plan.batch_count, references, objects, references - blocks, blocks, plan.template["output_ring_bytes"], plan.row_stride_bytes, plan.cache_capacity_bytes,
        physical, payload, physical / payload if payload else None,
        data_io_ops=blocks, indices_io_ops=sparse_blocks, gap_bytes=physical - payload, io_span_bytes=physical,
        predicted_io_seconds=physical / merge.io_bandwidth_bytes_per_second + (blocks + sparse_blocks) / merge.io_operations_per_second,
        max_decoded_bytes_per_job=int(decoded.max()) if len(decoded) else 0, residency_loads=blocks, independent_block_loads=blocks, executable_tasks=references + plan.batch_count,
        compile_time_io_ops=len(plan.template["sources"]), compile_time_io_bytes=meta_bytes, cache_horizon_max_batches=horizon,
    )


def request_stats(request: DataFrame, block_rows: list[int], batch_size: int) -> DataFrame:
    """One row of the same block counters for a request (pos, source_id, row) of any size.

    (input_rows, jobs, block_jobs, unique_blocks, cache_reference_hits, cache_reference_misses)
    """
    size = F.get(int_array(block_rows, "bigint"), F.col("source_id").cast("int"))
    asked = request.select(F.expr(f"pos div {batch_size}").alias("batch"), "source_id", F.floor(F.col("row") / size).cast("long").alias("block"))
    met = asked.groupBy("batch", "source_id", "block").agg(F.count("*").alias("n"))
    blocks = met.groupBy("source_id", "block").agg(F.sum("n").alias("n"), F.count("*").alias("batches"))
    counted = blocks.agg(F.sum("n").alias("input_rows"), F.sum("batches").alias("block_jobs"), F.count("*").alias("unique_blocks"))
    jobs = request.agg(F.expr(f"max(pos) div {batch_size} + 1").cast("long").alias("jobs"))
    whole = counted.unionByName(jobs, allowMissingColumns=True).agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("input_rows", "jobs", "block_jobs", "unique_blocks")])
    return whole.withColumn("cache_reference_hits", F.col("block_jobs") - F.col("unique_blocks")).withColumn("cache_reference_misses", F.col("unique_blocks"))
