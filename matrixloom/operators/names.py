"""Alignment by name: exact strings, first match. Short lists on the driver, long ones as DataFrames (pos, name)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_str_tuple(names: Iterable[str], argument: str = "names") -> tuple[str, ...]:
    if isinstance(names, (str, bytes)):
        raise TypeError(f"{argument} must be a sequence of strings, not one string")
    out = tuple(names)
    for n in out:
        if not isinstance(n, str):
            raise TypeError(f"{argument} must hold strings, got {type(n).__name__}")
    return out


def first_positions(names: DataFrame) -> DataFrame:
    """(name, pos) with the first position of each name."""
    return names.groupBy("name").agg(F.min("pos").alias("pos"))


def feature_map(source: DataFrame, target: DataFrame) -> DataFrame:
    """(src_col, out_col) for every source name: the first equal target, claimed by the first source column of that name; else null."""
    claims = first_positions(source).join(first_positions(target).withColumnRenamed("pos", "out_col"), "name").select(F.col("pos").alias("src_col"), "out_col")
    return source.select(F.col("pos").alias("src_col")).join(claims, "src_col", "left")


def build_feature_map(source_names: Iterable[str], target_names: Iterable[str]) -> tuple[int | None, ...]:
    """The same for short lists."""
    targets = {n: i for i, n in reversed(list(enumerate(as_str_tuple(target_names, "target_names"))))}
    return tuple(targets.pop(n, None) for n in as_str_tuple(source_names, "source_names"))


def locate(names: DataFrame, requested: DataFrame, missing: str = "error") -> DataFrame:
    """(pos, row): first position in `names` of each requested name, in request order; absent ones fail the job or drop out."""
    if missing not in ("error", "drop"):
        raise ValueError("missing must be 'error' or 'drop'")
    found = requested.join(first_positions(names).withColumnRenamed("pos", "row"), "name", "inner" if missing == "drop" else "left")
    if missing == "error":
        message = F.concat(F.lit("name '"), F.col("name"), F.lit("' is not present"))
        found = found.withColumn("row", F.when(F.col("row").isNotNull(), F.col("row")).otherwise(F.raise_error(message).cast("long")))
    return found.select("pos", "row")


def absent(names: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested rows without a match."""
    return requested.join(names.select("name").distinct(), "name", "left_anti")


def locate_names(names: Iterable[str], requested: Iterable[str], *, missing: str = "error") -> np.ndarray:
    """The same for short lists: an array of positions."""
    if missing not in ("error", "drop"):
        raise ValueError("missing must be 'error' or 'drop'")
    first = {n: i for i, n in reversed(list(enumerate(as_str_tuple(names, "names"))))}
    asked = as_str_tuple(requested, "requested")
    if missing == "error" and (lost := next((n for n in asked if n not in first), None)) is not None:
        raise ValueError(f"name {lost!r} is not present")
    return np.array([first[n] for n in asked if n in first], np.uint64)
