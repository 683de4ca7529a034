"""Small column-expression helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once per row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def int_array(values: Iterable[int], kind: str = "int") -> Column:
    """A constant array of integers; one folded literal however long, so plans and generated code stay small."""
    text = ",".join(str(int(v)) for v in values)
    return F.split(F.lit(text), ",").cast(f"array<{kind}>") if text else F.array().cast(f"array<{kind}>")
