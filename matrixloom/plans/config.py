"""Limits and hints. Limits are enforced; hints about I/O and workers are checked and handed to Spark or left to it."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import SparkSession

from ..sources.options import as_int

# The names and defaults of all settings below are fixed values of the interface.
KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
U32 = (1 << 32) - 1


def _ints(self: Any, names: tuple[str, ...], minimum: int = 1) -> None:
    for n in names:
        object.__setattr__(self, n, as_int(getattr(self, n), n, minimum))


@dataclass(frozen=True)
class ResourceLimits:
    max_output_buffer_bytes: int = 2 * GIB
    max_compile_arena_bytes: int = 2 * GIB
    max_compile_working_set_bytes: int = 40 * GIB
    max_retained_whole_key_bytes: int = 512 * MIB
    max_blocks_per_job: int = 4096
    max_cells_per_job: int = 1_000_000
    max_encoded_bytes_per_side: int = GIB
    max_decoded_bytes_per_job: int = 2 * GIB

    def __post_init__(self) -> None:
        _ints(self, tuple(f.name for f in fields(self) if f.name != "max_retained_whole_key_bytes"))
        _ints(self, ("max_retained_whole_key_bytes",), 0)
        if max(self.max_compile_arena_bytes, self.max_retained_whole_key_bytes) > self.max_compile_working_set_bytes:
            raise ValueError("parts of the compiler's memory exceed max_compile_working_set_bytes")
        if max(self.max_encoded_bytes_per_side, self.max_decoded_bytes_per_job) > U32:
            raise ValueError("bytes of a job must fit 32 bits")


@dataclass(frozen=True)
class IoMergeConfig:
    """How reads are joined: Spark's file splits and open costs follow it."""

    policy: str = "adjacent"
    max_coalesced_io_bytes: int = 32 * MIB
    max_io_gap_bytes: int = 0
    max_io_amplification_ratio: float = 1.0
    max_decode_ops_per_io_task: int = 64
    max_decoded_bytes_per_io_task: int = 64 * MIB
    max_encoded_staging_bytes_per_task: int = 32 * MIB
    io_bandwidth_bytes_per_second: float = 8.0 * GIB
    io_operations_per_second: float = 100_000.0
    io_merge_delta_bytes: int = 4096
    initialize_parallelism_hint: int = 32
    regular_io_parallelism_hint: int = 32
    min_tasks_per_worker: int = 2

    def __post_init__(self) -> None:
        if not isinstance(self.policy, str):
            raise TypeError("policy must be a string")
        object.__setattr__(self, "policy", self.policy.strip().lower())
        if self.policy not in ("off", "adjacent", "cost"):
            raise ValueError("policy must be 'off', 'adjacent' or 'cost'")
        real = ("max_io_amplification_ratio", "io_bandwidth_bytes_per_second", "io_operations_per_second")
        zero = ("max_io_gap_bytes", "io_merge_delta_bytes")
        _ints(self, zero, 0)
        _ints(self, tuple(f.name for f in fields(self) if f.name not in (*real, *zero, "policy")))
        for n in real:
            v = float(getattr(self, n))
            if not (math.isfinite(v) and v > 0):
                raise ValueError(f"{n} must be positive and finite")
            object.__setattr__(self, n, v)
        if self.max_coalesced_io_bytes > self.max_encoded_staging_bytes_per_task:
            raise ValueError("max_coalesced_io_bytes exceeds max_encoded_staging_bytes_per_task")
        if self.policy == "adjacent":
            object.__setattr__(self, "max_io_gap_bytes", 0)
            object.__setattr__(self, "max_io_amplification_ratio", 1.0)

    def spark_conf(self) -> dict[str, str]:
        """Settings of the session that stand for this policy."""
        size = self.max_coalesced_io_bytes if self.policy != "off" else 4 * MIB
        return {"spark.sql.files.maxPartitionBytes": str(max(size, MIB)), "spark.sql.files.openCostInBytes": str(max(int(self.io_bandwidth_bytes_per_second / self.io_operations_per_second), 4 * KIB))}

    def apply(self, spark: SparkSession) -> None:
        for k, v in self.spark_conf().items():
            spark.conf.set(k, v)


@dataclass(frozen=True)
class PlanConfig:
    compile_io_concurrency: int = field(default_factory=lambda: min(os.cpu_count() or 1, 32))
    io_merge: IoMergeConfig = field(default_factory=IoMergeConfig)
    cache_capacity_bytes: int = 64 * MIB
    cache_alignment: int = 64
    cache_fragmentation_slack_bytes: int = 64 * KIB
    limits: ResourceLimits = field(default_factory=ResourceLimits)

    def __post_init__(self) -> None:
        if not isinstance(self.io_merge, IoMergeConfig) or not isinstance(self.limits, ResourceLimits):
            raise TypeError("io_merge and limits must be of their classes")
        _ints(self, ("compile_io_concurrency", "cache_capacity_bytes"))
        _ints(self, ("cache_fragmentation_slack_bytes",), 0)
        _ints(self, ("cache_alignment",), 64)
        if self.cache_alignment & (self.cache_alignment - 1):
            raise ValueError("cache_alignment must be a power of two")


@dataclass(frozen=True)
class SessionConfig:
    num_workers: int = field(default_factory=lambda: os.cpu_count() or 1)
    initialize_workers: int | None = None
    initialize_inflight_io_ops: int | None = None
    initialize_inflight_encoded_bytes: int = 512 * MIB
    io_mode: str = "auto"
    queue_depth: int = 64
    max_inflight_jobs_per_worker: int = 32
    max_inflight_encoded_bytes_per_worker: int = 512 * MIB
    max_decoded_bytes_per_worker: int = 2 * GIB
    max_total_inflight_io_ops: int | None = None
    max_total_inflight_encoded_bytes: int | None = None
    max_total_decoded_bytes: int | None = None

    def __post_init__(self) -> None:
        _ints(self, ("num_workers", "initialize_inflight_encoded_bytes", "max_inflight_jobs_per_worker", "max_inflight_encoded_bytes_per_worker", "max_decoded_bytes_per_worker"))
        workers = self.num_workers if self.initialize_workers is None else as_int(self.initialize_workers, "initialize_workers", 1)
        object.__setattr__(self, "initialize_workers", workers)
        object.__setattr__(self, "initialize_inflight_io_ops", workers if self.initialize_inflight_io_ops is None else as_int(self.initialize_inflight_io_ops, "initialize_inflight_io_ops", 1))
        if not isinstance(self.io_mode, str):
            raise TypeError("io_mode must be a string")
        object.__setattr__(self, "io_mode", self.io_mode.strip().lower())
        if self.io_mode not in ("auto", "blocking", "uring"):
            raise ValueError("io_mode must be 'auto', 'blocking' or 'uring'")
        depth = as_int(self.queue_depth, "queue_depth", 0, U32)
        if self.io_mode != "blocking" and depth < 2:
            raise ValueError("queue_depth must be at least 2 unless io_mode is 'blocking'")
        needed = {
            "max_total_inflight_io_ops": max(self.num_workers * (1 if self.io_mode == "blocking" else depth), self.initialize_inflight_io_ops),
            "max_total_inflight_encoded_bytes": max(self.num_workers * self.max_inflight_encoded_bytes_per_worker, self.initialize_inflight_encoded_bytes),
            "max_total_decoded_bytes": max(self.num_workers, workers) * self.max_decoded_bytes_per_worker,
        }
        for name, least in needed.items():
            given = getattr(self, name)
            if given is not None and as_int(given, name, 1) < least:
                raise ValueError(f"{name}={given} is smaller than the required {least}")

    @property
    def look_ahead(self) -> bool:
        """Whether the next partition is fetched while one is consumed."""
        return self.queue_depth > 1
