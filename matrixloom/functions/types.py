"""The eight value types, promotion between them, and the expressions that convert columns."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import PromotionError  # type: ignore[attr-defined]

OVERFLOW_POLICIES = ("error", "use_fill", "use_value", "unchecked")


@dataclass(frozen=True)
class DType:
    name: str
    spark: T.DataType

    @property
    def numpy(self) -> np.dtype:
        return np.dtype({"u": "uint", "i": "int", "f": "float"}[self.name[0]] + self.name[1:])

    @property
    def bits(self) -> int:
        return int(self.name[1:])

    @property
    def itemsize(self) -> int:
        return self.bits // 8

    @property
    def is_float(self) -> bool:
        return self.name[0] == "f"

    @property
    def signed(self) -> bool:
        return self.name[0] != "u"

    @property
    def low(self) -> int:
        return -(1 << self.bits - 1) if self.signed else 0

    @property
    def high(self) -> int:
        return (1 << self.bits - self.signed) - 1

    def literal(self, value: Any) -> Column:
        return F.lit(str(value) if self.name == "u64" else value).cast(self.spark)


# Unsigned types are stored in the next wider signed one; the tag travels in metadata.
DTYPES = {
    d.name: d
    for d in (
        DType("u16", T.IntegerType()), DType("u32", T.LongType()), DType("u64", T.DecimalType(20, 0)),
        DType("i16", T.ShortType()), DType("i32", T.IntegerType()), DType("i64", T.LongType()),
        DType("f32", T.FloatType()), DType("f64", T.DoubleType()),
    )
}
INDEX_DTYPES = ("u16", "u32")


def dtype(value: Any) -> DType:
    """The value type named by a DType, one of the eight names, or anything numpy takes as a dtype."""
    if isinstance(value, DType):
        return value
    if isinstance(value, str) and value in DTYPES:
        return DTYPES[value]
    try:
        d = np.dtype(value)
    except TypeError as e:
        raise TypeError(f"not a value type: {value!r}") from e
    name = f"{d.kind}{d.itemsize * 8}"
    if name not in DTYPES:
        raise ValueError(f"unsupported value type {d.name}; expected one of {sorted(DTYPES)}")
    return DTYPES[name]


def is_value_dtype(value: Any) -> bool:
    try:
        dtype(value)
    except (TypeError, ValueError):
        return False
    return True


def is_index_dtype(value: Any) -> bool:
    return is_value_dtype(value) and dtype(value).name in INDEX_DTYPES


def promotion(src: Any, dst: Any) -> str | None:
    """How src values become dst: identity, widen, exact, rounding, checked; None if that is not offered.

    Nothing narrows. Integers go to floats exactly where the fraction holds them and by opted-in rounding where
    the width is the same at least; a change of sign at the same width or more is checked value by value.
    """
    s, d = dtype(src), dtype(dst)
    if s == d:
        return "identity"
    if s.is_float:
        return "widen" if d.is_float and d.bits > s.bits else None
    if d.is_float:
        if s.bits - s.signed <= (24 if d.bits == 32 else 53):
            return "exact"
        return "rounding" if d.bits >= s.bits else None
    if d.low <= s.low and s.high <= d.high:
        return "widen"
    return "checked" if d.bits >= s.bits else None


def check_promotion(src: Any, dst: Any, allow_float_rounding: bool = False) -> str:
    kind = promotion(src, dst)
    if kind is None:
        raise PromotionError(f"{dtype(src).name} cannot be promoted to {dtype(dst).name}")
    if kind == "rounding" and not allow_float_rounding:
        raise PromotionError(f"{dtype(src).name} to {dtype(dst).name} may round; allow_float_rounding permits it")
    return kind


def wrap(value: Column, dst: DType) -> Column:
    """Two's-complement reinterpretation in dst's width."""
    span = F.lit(str(1 << dst.bits)).cast("decimal(38,0)")
    low = F.lit(str(dst.low)).cast("decimal(38,0)")
    return (F.pmod(value.cast("decimal(38,0)") - low, span) + low).cast(dst.spark)


def convert(value: Column, src: Any, dst: Any, *, fill: Any = 0, overflow: str = "error", overflow_value: Any = None, allow_float_rounding: bool = False) -> Column:
    """value of type src as dst. Only the nine checked edges look at `overflow`."""
    s, d = dtype(src), dtype(dst)
    kind = check_promotion(s, d, allow_float_rounding)
    if kind == "rounding" and d.bits == 32:
        # by way of double, which is exact: the optimiser drops a widening cast to float in front of another one
        return value.cast("double").cast(d.spark)
    if kind != "checked":
        return value.cast(d.spark)
    if overflow == "unchecked":
        return wrap(value, d)
    wide = value.cast("decimal(20,0)")
    limit = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    bad = (wide < limit(d.low)) | (wide > limit(d.high))
    if overflow == "error":
        message = F.concat(F.lit("[conversion] "), value.cast("string"), F.lit(f" does not fit {d.name}"))
        instead = F.raise_error(message).cast(d.spark)
    else:
        instead = d.literal(fill if overflow == "use_fill" else overflow_value)
    return F.when(bad, instead).otherwise(wide.cast(d.spark))


def normalize_fill(value: Any, target: Any, name: str = "fill") -> int | float:
    """A fill in range of its type: integers for integer types, floats that stay finite for float types."""
    d = dtype(target)
    if isinstance(value, (bool, np.bool_)):
        raise TypeError(f"{name} must be a number, not bool")
    if d.is_float:
        if not isinstance(value, (int, float, np.integer, np.floating)):
            raise TypeError(f"{name} must be a number")
        out = float(value)
        with np.errstate(over="ignore"):
            narrowed = float(d.numpy.type(out))
        if math.isfinite(out) and not math.isfinite(narrowed):
            raise ValueError(f"{name}={value!r} overflows {d.name}")
        return narrowed
    if isinstance(value, (float, np.floating)) and float(value).is_integer():
        value = int(value)
    if not isinstance(value, (int, np.integer)):
        raise TypeError(f"{name} must be an integer for {d.name}")
    if not d.low <= int(value) <= d.high:
        raise ValueError(f"{name}={value!r} is out of range for {d.name}")
    return int(value)
