"""Delivery of batches: to one consumer, lazily, or dealt round-robin to ranks.

Executors pack each batch into one binary value; the driver (or a rank's process) only wraps it as an array.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import CancelledError, SessionError, from_spark  # type: ignore[attr-defined]
from ..operators.matrix import BATCHES, packed_batches
from ..operators.scratch import shared_folder
from ..plans.config import SessionConfig
from ..plans.stats import RuntimeStats
from ..sources.fs import Files

def packed(plan: Any, rank: int | None = None, world_size: int = 1) -> DataFrame:
    """(batch_id, n, data) in batch order; one shuffle deals rows to their batches."""
    rows = plan.frame(rank, world_size)
    if rank is None:
        return packed_batches(rows, plan.batch_count, plan.output.dtype, plan.n_cols)
    turns = rows.withColumn("batch_id", F.expr(f"batch_id div {world_size}"))
    out = packed_batches(turns, -(-plan.batch_count // world_size), plan.output.dtype, plan.n_cols)
    return out.withColumn("batch_id", F.col("batch_id") * world_size + rank)


def spool(plan: Any, world_size: int) -> str:
    """Folder of all packed batches by rank: the sources are read once, whatever the number of ranks."""
    path = f"{shared_folder(plan.spark)}/ranks-{uuid.uuid4().hex}"
    packed(plan).withColumn("rank", F.pmod("batch_id", F.lit(world_size)).cast("int")).write.partitionBy("rank").parquet(path)
    return path


def spooled(plan: Any, path: str, rank: int, world_size: int) -> DataFrame:
    """(batch_id, n, data) of one rank, in batch order, from a spool; only that rank's files are read."""
    rows = plan.spark.read.schema("batch_id long, n long, data binary, rank int").parquet(path).where(F.col("rank") == rank).drop("rank")
    parts = max(1, -(-plan.batch_count // (BATCHES * world_size)))
    return rows.repartitionById(parts, F.expr(f"cast(batch_id div {BATCHES * world_size} as int)")).sortWithinPartitions("batch_id")


class Session:
    """A pull iterator of [<= batch_size, n_cols] arrays, read-only unless copied."""

    def __init__(self, plan: Any, config: SessionConfig | None = None, *, copy: bool = False, rank: int | None = None, world_size: int = 1, source: str | None = None):
        if config is not None and not isinstance(config, SessionConfig):
            raise TypeError("config must be a SessionConfig")
        self.plan, self.config, self.copy, self.rank, self.world_size = plan, config or SessionConfig(), copy, rank, world_size
        self.source = source
        self.state, self.rows_yielded, self.batches_yielded = "running", 0, 0
        self._tag, self._rows, self._lock = f"batches-{uuid.uuid4().hex}", None, threading.Lock()

    def __len__(self) -> int:
        n = self.plan.batch_count
        return n if self.rank is None else max(0, (n - 1 - self.rank) // self.world_size + 1)

    def __iter__(self) -> Iterator[np.ndarray]:
        return self

    def _start(self) -> None:
        context = self.plan.spark.sparkContext
        context.addJobTag(self._tag)
        try:
            batches = packed(self.plan, self.rank, self.world_size) if self.source is None else spooled(self.plan, self.source, self.rank, self.world_size)
            self._rows = iter(batches.toLocalIterator(prefetchPartitions=self.config.look_ahead))
        finally:
            context.removeJobTag(self._tag)

    def __next__(self) -> np.ndarray:
        if self.state == "cancelled":
            raise CancelledError("the session was cancelled")
        if self.state in ("finished", "closed"):
            raise StopIteration
        if self.state == "failed":
            raise SessionError("the session has failed")
        try:
            if self._rows is None:
                self._start()
            row = next(self._rows)
        except StopIteration:
            self.state = "finished"
            raise
        except Exception as e:
            if self.state == "cancelled":
                raise CancelledError("the session was cancelled") from e
            self.state = "failed"
            raise SessionError(str(from_spark(e)).split("\n", 1)[0]) from from_spark(e)
        out = np.frombuffer(row.data, self.plan.dtype).reshape(row.n, self.plan.n_cols)
        self.rows_yielded += row.n
        self.batches_yielded += 1
        return out.copy() if self.copy else out

    def read(self) -> np.ndarray:
        """All batches that are left, in one array."""
        parts = list(self)
        return np.concatenate(parts) if parts else np.empty((0, self.plan.n_cols), self.plan.dtype)

    iter_batches = __iter__

    @property
    def progress(self) -> float:
        return self.batches_yielded / len(self) if len(self) else 1.0

    @property
    def stats(self) -> RuntimeStats:
        return RuntimeStats(self.state, self.rows_yielded, self.batches_yielded, self.rows_yielded * self.plan.output.row_nbytes)

    def info(self) -> dict:
        return {"state": self.state, "rank": self.rank, "world_size": self.world_size, "batches": len(self), "io_mode": "spark"}

    def cancel(self) -> None:
        with self._lock:
            if self.state == "running":
                self.state = "cancelled"
                self.plan.spark.sparkContext.cancelJobsWithTag(self._tag)

    def close(self) -> None:
        with self._lock:
            if self.state == "running":
                self.plan.spark.sparkContext.cancelJobsWithTag(self._tag)
                self.state = "closed"
            self._rows = None

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


class Prefetch:
    """A session that opens on first use."""

    def __init__(self, plan: Any, config: SessionConfig | None = None, *, copy: bool = False):
        self.plan, self.config, self.copy, self.session, self._closed = plan, config, copy, None, False

    @property
    def state(self) -> str:
        return "closed" if self._closed and self.session is None else "unopened" if self.session is None else self.session.state

    def __len__(self) -> int:
        return self.plan.batch_count

    def __iter__(self) -> Prefetch:
        return self

    def __next__(self) -> np.ndarray:
        if self.session is None:
            if self._closed:
                raise StopIteration
            self.session = self.plan.open(self.config, copy=self.copy)
        return next(self.session)

    def read(self) -> np.ndarray:
        parts = list(self)
        return np.concatenate(parts) if parts else np.empty((0, self.plan.n_cols), self.plan.dtype)

    def cancel(self) -> None:
        if self.session is None:
            self.session = self.plan.open(self.config, copy=self.copy)
        self.session.cancel()

    def close(self) -> None:
        self._closed = True
        if self.session is not None:
            self.session.close()

    def __enter__(self) -> Prefetch:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


class RankIterator:
    """One rank's batches: batch i goes to rank i mod world_size. Pickles until it is used, and then only where it is."""

    def __init__(self, image: bytes, rank: int, world_size: int, config: SessionConfig | None = None, copy: bool = False, source: str | None = None):
        self.image, self.rank, self.world_size, self.config, self.copy, self.source, self._session = image, rank, world_size, config, copy, source, None

    def __getstate__(self) -> dict:
        if self._session is not None:
            raise TypeError("a rank's iterator moves only before its first use")
        return self.__dict__

    def _open(self) -> Session:
        if self._session is None:
            from ..plans.plan import Plan

            plan = Plan.loads(self.image)
            self._session = Session(plan, self.config, copy=self.copy, rank=self.rank, world_size=self.world_size, source=self.source)
        return self._session

    def __len__(self) -> int:
        return len(self._open())

    def __iter__(self) -> RankIterator:
        return self

    def __next__(self) -> np.ndarray:
        return next(self._open())

    def cancel(self) -> None:
        self._open().cancel()

    def close(self) -> None:
        if self._session is not None:
            self._session.close()

    def __enter__(self) -> RankIterator:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


class DistributedSession:
    """Hands out each rank once. Ranks read on their own; back-pressure is each rank's own pull.

    A rank looks for its rows in the sources itself, or with `spooled` in batches that are written to the shared folder
    once, which pays where there are many ranks. The spool goes when the session is closed.
    """

    def __init__(self, plan: Any, world_size: int, config: SessionConfig | None = None, *, spooled: bool = False):
        from ..sources.options import as_int

        self.plan, self.world_size, self.config, self.spooled = plan, as_int(world_size, "world_size", 1), config, spooled
        self._source: str | None = None
        self._given: set[int] = set()
        self._made: list[RankIterator] = []

    def rank(self, r: int, *, copy: bool = False) -> RankIterator:
        if not 0 <= r < self.world_size:
            raise ValueError(f"rank {r} of {self.world_size}")
        if r in self._given:
            raise ValueError(f"rank {r} was given out already")
        if self.spooled and self._source is None:
            self._source = spool(self.plan, self.world_size)
        out = RankIterator(self.plan.dumps(), r, self.world_size, self.config, copy, self._source)
        self._given.add(r)
        self._made.append(out)
        return out

    def ranks(self, *, copy: bool = False) -> list[RankIterator]:
        """All ranks that are left, or none if one cannot be made."""
        left = [r for r in range(self.world_size) if r not in self._given]
        before = set(self._given)
        try:
            return [self.rank(r, copy=copy) for r in left]
        except BaseException:
            self._given = before
            raise

    def frame(self, r: int) -> DataFrame:
        """A rank's rows as a DataFrame, for consumers that run in Spark."""
        return self.plan.frame(r, self.world_size)

    def cancel(self) -> None:
        for it in self._made:
            if it._session is not None:
                it._session.cancel()

    def wait(self) -> None:
        return None

    def close(self) -> None:
        for it in self._made:
            it.close()
        if self._source is not None:
            Files(self.plan.spark, self._source).delete()
            self._source = None

    def __enter__(self) -> DistributedSession:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()
