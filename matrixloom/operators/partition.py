"""Partitions of rows into chunks: a fixed number of rows, or a budget of bytes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import ConversionError  # type: ignore[attr-defined]
from ..functions.types import dtype
from .matrix import Matrix
from .scratch import keep

#: Defaults (fixed values): bytes of a chunk and of a block.
CHUNK_BUDGET, BLOCK_BUDGET = 100 << 20, 64 << 10


def fixed_cells(row: Column, n: int) -> Column:
    if n < 1:
        raise ValueError("a part needs at least one row")
    return F.floor(row / F.lit(n)).cast("long")


def dense_cells(n_cols: int, itemsize: int, budget: int) -> int:
    """Rows that meet or just exceed a byte budget."""
    if budget < 1:
        raise ValueError("budget must be at least 1")
    return max(1, ceil(budget / max(1, n_cols * itemsize)))


def budget_groups(costs: Iterable[int], budget: int) -> list[tuple[int, int]]:
    """Greedy whole-row packing: a group closes when it is not empty and the next row would exceed the budget."""
    out: list[tuple[int, int]] = []
    start = used = end = 0
    for i, c in enumerate(costs):
        if i > start and used + c > budget:
            out.append((start, i))
            start, used = i, 0
        used, end = used + c, i + 1
    return [*out, (start, end)] if end else out


#: Rows of a bucket that one task packs at once (16 MB).
BUCKET_ROWS = 1 << 20
#: Buckets whose exits one task composes, or their number's root if that is more.
SPAN = 64


class Exits:
    """How a run of rows is left, by how full the group is that is open when the run is entered.

    An open group that is u full goes on until it meets a row whose least[i] exceeds budget - u; the run is then left
    with a group of used[i] bytes open, after groups[i] groups were begun. Without such a row it is left u + total full.
    """

    def __init__(self, least: np.ndarray, used: np.ndarray, groups: np.ndarray, total: int, budget: int):
        kept = int(np.searchsorted(least, budget, side="right")) + 1  # an empty open group goes no further
        self.least, self.used, self.groups, self.total, self.budget = least[:kept], used[:kept], groups[:kept], total, budget

    @classmethod
    def of(cls, costs: np.ndarray, budget: int) -> Exits:
        done, after = _starts(costs, budget)
        n = len(costs)
        last, groups, follow = list(range(n)), [1] * n, after.tolist()
        for i in range(n - 1, -1, -1):
            if follow[i] < n:
                last[i], groups[i] = last[follow[i]], groups[follow[i]] + 1
        return cls(done[1:], done[n] - done[np.array(last, np.int64)], np.array(groups, np.int64), int(done[n]), budget)

    def enter(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the group that is open at the end, groups begun) for open groups of `used` bytes."""
        at = np.searchsorted(self.least, self.budget - used, side="right")
        closed, i = at < len(self.least), np.minimum(at, len(self.least) - 1)
        return np.where(closed, self.used[i], used + self.total), np.where(closed, self.groups[i], 0)

    def then(self, other: Exits) -> Exits:
        """Both runs as one; associative."""
        used, groups = other.enter(self.used)
        return Exits(
            np.concatenate([self.least, self.total + other.least]), np.concatenate([used, other.used]), np.concatenate([self.groups + groups, other.groups]), self.total + other.total, self.budget,
        )

    def row(self, name: str, number: int):
        import pyarrow as pa

        lists = {c: pa.array([getattr(self, c)], pa.list_(pa.int64())) for c in ("least", "used", "groups")}
        return pa.table({name: pa.array([number], pa.int64()), **lists, "total": pa.array([self.total], pa.int64())})

    @classmethod
    def read(cls, row: dict, budget: int) -> Exits:
        return cls(*(np.array(row[c], np.int64) for c in ("least", "used", "groups")), row["total"], budget)


def _starts(costs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(running sums of costs from 0, start of the group after one that starts at each row, or the number of rows)."""
    done = np.concatenate([[0], np.cumsum(costs, dtype=np.int64)])
    after = np.searchsorted(done, done[:-1] + budget, side="right") - 1
    return done, np.maximum(after, np.arange(1, len(done)))


def bytes_budget(rows: DataFrame, budget: int, n_rows: int | None = None) -> DataFrame:
    """(row, cost) with the group of each row added, groups by greedy packing in row order.

    Where a group ends depends on all groups before it. So every bucket of BUCKET_ROWS rows gives, for each state of the
    group that is open before it, the state after it; these functions are composed for spans of buckets, the driver
    follows the spans (a table each, as long as a budget's rows), and with its own entry state known every bucket is
    packed by itself. Costs are counted in 16 bytes a row; the cells do not move. n_rows saves a look for the last row.
    """
    import pyarrow as pa

    if budget < 1:
        raise ValueError("budget must be at least 1")
    rows = rows.select(F.col("row").cast("long").alias("row"), F.col("cost").cast("long").alias("cost"), F.expr(f"cast(row as long) div {BUCKET_ROWS}").alias("bucket"))
    if n_rows is None:
        n_rows = (rows.agg(F.max("row")).first()[0] or 0) + 1
    buckets = -(-n_rows // BUCKET_ROWS)
    span = max(SPAN, ceil(buckets**0.5))

    def groups(table):
        table = table.sort_by("row")
        costs = table["cost"].to_numpy()
        _, after = _starts(costs, budget)
        begins = np.zeros(len(costs), np.int64)
        at = int(np.searchsorted(np.cumsum(costs), budget - table["used"][0].as_py(), side="right"))
        while at < len(costs):
            begins[at], at = 1, int(after[at])
        return pa.table({"row": table["row"], "cost": table["cost"], "grp": pa.array(table["group"][0].as_py() + np.cumsum(begins))})

    if buckets <= 1:
        entered = rows.withColumn("used", F.lit(budget + 1).cast("long")).withColumn("group", F.lit(-1).cast("long"))
        return entered.groupBy("bucket").applyInArrow(groups, "row long, cost long, grp long")

    kind = "least array<long>, used array<long>, groups array<long>, total long"

    def exits(table):
        table = table.sort_by("row")
        return Exits.of(table["cost"].to_numpy(), budget).row("bucket", table["bucket"][0].as_py())

    def runs(table, name):
        return [(r[name], Exits.read(r, budget)) for r in table.sort_by(name).to_pylist()]

    def composed(table):
        return reduce(Exits.then, (e for _, e in runs(table, "bucket"))).row("span", table["span"][0].as_py())

    def entries(table):
        used, group, out = table["entry"][0].as_py(), table["before"][0].as_py(), []
        for bucket, e in runs(table, "bucket"):
            out.append((bucket, used, group))
            left, begun = e.enter(np.array([used]))
            used, group = int(left[0]), group + int(begun[0])
        return pa.table({n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(("bucket", "used", "group"))})

    spark = rows.sparkSession
    rows = keep(rows, "costs")
    tables = keep(rows.groupBy("bucket").applyInArrow(exits, f"bucket long, {kind}").withColumn("span", F.expr(f"bucket div {span}")), "exits")
    used, group, known = budget + 1, -1, []
    for number, e in runs(tables.groupBy("span").applyInArrow(composed, f"span long, {kind}").toArrow(), "span"):
        known.append((number, used, group))
        left, begun = e.enter(np.array([used]))
        used, group = int(left[0]), group + int(begun[0])
    states = tables.join(F.broadcast(spark.createDataFrame(known, "span long, entry long, before long")), "span")
    states = states.groupBy("span").applyInArrow(entries, "bucket long, used long, `group` long")
    return rows.join(states, "bucket").groupBy("bucket").applyInArrow(groups, "row long, cost long, grp long")


def integerize(values: DataFrame, value: str = "value", atol: float = 1e-3, low: float = -1e-4) -> DataFrame:
    """One row (ok, top, dtype): whether counts are integers within atol and not negative, their largest, and the unsigned type that holds it."""
    v = F.col(value).cast("double")
    whole = values.agg(F.coalesce(F.bool_and((v >= low) & (F.abs(v - F.rint(v)) <= atol)), F.lit(True)).alias("ok"), F.coalesce(F.max(F.rint(v)), F.lit(0.0)).cast("long").alias("top"))
    kind = F.when(~F.col("ok"), F.lit(None)).when(F.col("top") < 1 << 16, "u16").when(F.col("top") < 1 << 32, "u32")
    return whole.select("ok", "top", kind.alias("dtype"))


def integerize_matrix(matrix: Matrix, atol: float = 1e-3, low: float = -1e-4) -> Matrix:
    """Counts kept as floats, as the unsigned type that holds them; refused if any is negative or not an integer."""
    got = integerize(matrix.coo(), "value", atol, low).first()
    if not got.ok or got.dtype is None:
        raise ConversionError("the values are not counts")
    d = dtype(got.dtype)
    return replace(matrix, frame=matrix.frame.withColumn("values", F.transform("values", lambda v: F.rint(v).cast(d.spark))), dtype=d)
