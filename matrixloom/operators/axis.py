"""Keys of one axis: all, ranges, strides, positions. Pure driver code that chooses the cheapest relational form."""

from __future__ import annotations

from dataclasses import dataclass
from operator import index
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AxisSpec:
    """kind is all, range (payload start, stop), strided (start, step) or positions (int64 array); length is the result's."""

    kind: str
    payload: Any
    length: int

    def positions(self) -> np.ndarray:
        if self.kind == "all":
            return np.arange(self.length, dtype=np.int64)
        if self.kind == "range":
            return np.arange(*self.payload, dtype=np.int64)
        if self.kind == "strided":
            start, step = self.payload
            return start + step * np.arange(self.length, dtype=np.int64)
        return self.payload

    # --- relational forms ---

    def predicate(self, row: Column) -> Column | None:
        """A filter on `row` that the scan can prune by; exact but for positions, where it is their bounds."""
        if self.kind == "all":
            return None
        if not self.length:
            return F.lit(False)
        if self.kind == "range":
            return (row >= self.payload[0]) & (row < self.payload[1])
        if self.kind == "strided":
            start, step = self.payload
            ends = sorted((start, start + step * (self.length - 1)))
            return (row >= ends[0]) & (row <= ends[1]) & (F.pmod(row - start, F.lit(abs(step))) == 0)
        return (row >= int(self.payload.min())) & (row <= int(self.payload.max()))

    def place(self, row: Column) -> Column | None:
        """The output position of a selected row, where arithmetic gives it."""
        if self.kind == "all":
            return row.cast("long")
        if self.kind == "range":
            return (row - self.payload[0]).cast("long")
        if self.kind == "strided":
            start, step = self.payload
            return F.expr("0L") if not self.length else ((row - start) / F.lit(step)).cast("long")
        return None

    def request(self, spark: SparkSession) -> DataFrame:
        """(pos, row) of the positions, in order, duplicates kept."""
        import pyarrow as pa

        p = self.positions()
        return spark.createDataFrame(pa.table({"pos": pa.array(np.arange(len(p))), "row": pa.array(p)}))


ALL = Ellipsis


def from_positions(positions: np.ndarray) -> AxisSpec:
    """The narrowest spec of a list of positions: equal steps become a range or a stride."""
    p = np.ascontiguousarray(positions, np.int64)
    if len(p) == 0:
        return AxisSpec("range", (0, 0), 0)
    if len(p) == 1:
        return AxisSpec("range", (int(p[0]), int(p[0]) + 1), 1)
    steps = np.diff(p)
    step = int(steps[0])
    if step and (steps == step).all():
        return AxisSpec("range", (int(p[0]), int(p[-1]) + 1), len(p)) if step == 1 else AxisSpec("strided", (int(p[0]), step), len(p))
    return AxisSpec("positions", p, len(p))


def _scalar(value: int, n: int, name: str) -> AxisSpec:
    at = value + n if value < 0 else value
    if not 0 <= at < n:
        raise IndexError(f"{name} index {value} out of range for axis of size {n}")
    return AxisSpec("range", (at, at + 1), 1)


def normalize_axis(key: Any, n: int, name: str = "axis") -> tuple[AxisSpec, bool]:
    """(spec, whether the key was a scalar)."""
    if key is None or key is Ellipsis:
        return AxisSpec("all", None, n), False
    if isinstance(key, AxisSpec):
        return key, False
    if isinstance(key, slice):
        start, stop, step = key.indices(n)
        length = len(range(start, stop, step))
        if step == 1:
            return (AxisSpec("all", None, n) if length == n else AxisSpec("range", (start, start + length), length)), False
        return AxisSpec("strided", (start, step), length), False
    if isinstance(key, (bool, np.bool_)):
        raise TypeError(f"{name} index must not be a bare bool")
    if isinstance(key, (np.ndarray, list, tuple, range)):
        try:
            a = np.asarray(key)
        except (TypeError, ValueError, OverflowError) as e:
            raise TypeError(f"{name} index is not an array: {e}") from e
        if a.dtype == np.bool_ and a.ndim:
            if a.ndim != 1:
                raise IndexError(f"{name} mask must have one dimension, not {a.ndim}")
            if len(a) != n:
                raise IndexError(f"{name} mask has {len(a)} entries for an axis of size {n}")
            return from_positions(np.flatnonzero(a)), False
        if a.ndim == 0:
            return normalize_axis(a.item(), n, name)
        if a.ndim == 2 and 1 in a.shape:
            a = a.reshape(-1)
        if a.ndim != 1:
            raise IndexError(f"{name} index must have one dimension, not {a.ndim}")
        if a.size and a.dtype.kind not in "iu":
            raise IndexError(f"{name} index must hold integers, not {a.dtype}")
        if a.size and a.dtype.kind == "u" and int(a.max()) > np.iinfo(np.int64).max:
            raise IndexError(f"{name} index is out of range")
        p = a.astype(np.int64)
        p = np.where(p < 0, p + n, p)
        wrong = (p < 0) | (p >= n)
        if wrong.any():
            raise IndexError(f"{name} index {int(np.asarray(a)[wrong][0])} out of range for axis of size {n}")
        return from_positions(p), False
    try:
        value = index(key)
    except TypeError as e:
        raise TypeError(f"{name} index must be an integer, slice, array or mask, not {type(key).__name__}") from e
    return _scalar(value, n, name), True


def normalize_key(key: Any, n_rows: int, n_cols: int) -> tuple[AxisSpec, AxisSpec, bool, bool]:
    """(rows, cols, rows scalar, cols scalar) of obj[key]."""
    parts = key if isinstance(key, tuple) else (key,)
    if len(parts) > 2:
        raise IndexError(f"too many indices for a matrix: {len(parts)}")
    parts = (*parts, *[None] * (2 - len(parts)))
    (rows, one_row), (cols, one_col) = normalize_axis(parts[0], n_rows, "row"), normalize_axis(parts[1], n_cols, "col")
    return rows, cols, one_row, one_col
