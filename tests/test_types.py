import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixloom.functions import errors, types

#: identity =, widen W, exact X, rounding R, checked C, not offered .
MATRIX = """
    i16 i32 i64 u16 u32 u64 f32 f64
i16 =   W   W   C   C   C   X   X
i32 .   =   W   .   C   C   R   X
i64 .   .   =   .   .   C   .   R
u16 C   W   W   =   W   W   X   X
u32 .   C   W   .   =   W   R   X
u64 .   .   C   .   .   =   .   R
f32 .   .   .   .   .   .   =   W
f64 .   .   .   .   .   .   .   =
"""
NAMES = {"=": "identity", "W": "widen", "X": "exact", "R": "rounding", "C": "checked", ".": None}


def test_promotion_matrix():
    head, *rows = [line.split() for line in MATRIX.strip().split("\n")]
    for src, *kinds in rows:
        for dst, k in zip(head, kinds):
            assert types.promotion(src, dst) == NAMES[k], (src, dst)


def test_dtype_names():
    assert types.dtype(np.float32).name == "f32" and types.dtype(">u8").name == "u64" and types.dtype("i16").itemsize == 2
    for bad in ("bool", "int8", "float16", "complex64"):
        with pytest.raises(ValueError):
            types.dtype(bad)
    assert types.is_index_dtype("u16") and not types.is_index_dtype("i32") and not types.is_value_dtype("S4")


def values(spark, rows, src, dst, **how):
    d = types.DTYPES[src]
    df = spark.createDataFrame([(str(v),) for v in rows], "v string").select(F.col("v").cast(d.spark).alias("v"))
    return [r[0] for r in df.select(types.convert(F.col("v"), src, dst, **how)).collect()]


def test_golden_conversions(spark):
    assert values(spark, [-3, 4], "i16", "u16", overflow="use_fill", fill=99) == [99, 4]
    assert values(spark, [-3, 4, 5, 6], "i16", "u16", overflow="use_value", overflow_value=777) == [777, 4, 5, 6]
    assert values(spark, [-3], "i16", "u32", overflow="unchecked") == [4294967293]
    assert values(spark, [16777217], "i32", "f32", allow_float_rounding=True) == [16777216.0]
    top = 2**64 - 1
    assert [int(v) for v in values(spark, [-1, 2**53 + 1], "i64", "u64", overflow="use_fill", fill=top)] == [top, 2**53 + 1]
    assert values(spark, [0, 2**63 + 1], "u64", "i64", overflow="use_fill", fill=-99) == [0, -99]
    assert values(spark, [2**64 - 1, 2**63], "u64", "i64", overflow="unchecked") == [-1, -(2**63)]
    assert values(spark, ["NaN", "Infinity"], "f32", "f64")[1] == float("inf")
    with pytest.raises(Exception, match="conversion"):
        values(spark, [-3, 4], "i16", "u16")
    for src, dst in (("i32", "f32"), ("f64", "f32"), ("f32", "i32"), ("i64", "i32")):
        with pytest.raises(errors.PromotionError):
            types.convert(F.lit(1), src, dst)


@pytest.mark.parametrize("policy", ["use_fill", "use_value", "unchecked"])
def test_every_checked_edge_against_numpy(spark, policy):
    for src in types.DTYPES.values():
        for dst in types.DTYPES.values():
            if types.promotion(src, dst) != "checked":
                continue
            rows = sorted({src.low, src.high, 0, 1, src.high // 2 + 1, max(src.low, -7)})
            got = [int(v) for v in values(spark, rows, src.name, dst.name, overflow=policy, fill=3, overflow_value=5 if policy == "use_value" else None)]
            inside = lambda v: dst.low <= v <= dst.high  # noqa: E731, B023
            wrapped = lambda v: (v - dst.low) % (1 << dst.bits) + dst.low  # noqa: E731, B023
            assert got == [v if inside(v) else {"use_fill": 3, "use_value": 5, "unchecked": wrapped(v)}[policy] for v in rows]


def test_fill_checks():
    assert types.normalize_fill(3.0, "u16") == 3 and types.normalize_fill(1, "f32") == 1.0 and np.isnan(types.normalize_fill(float("nan"), "f64"))
    for bad, d in ((-1, "u16"), (70000, "u16"), (1e39, "f32")):
        with pytest.raises(ValueError):
            types.normalize_fill(bad, d)
    for bad in (True, "x", 1.5):
        with pytest.raises(TypeError):
            types.normalize_fill(bad, "i32")


def test_error_kinds():
    assert errors.error_kind(errors.PromotionError("x")) == "promotion" and errors.error_kind(ValueError()) is None
    assert len(errors.KINDS) == 23 and issubclass(errors.ZipError, errors.Error)
