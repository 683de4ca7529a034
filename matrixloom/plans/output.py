"""What a plan's dense output looks like and how numbers get there."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

from ..functions.types import OVERFLOW_POLICIES, DType, dtype, normalize_fill
from ..sources.options import as_int


@dataclass(frozen=True, init=False)
class OutputSpec:
    """n_cols columns of one type. `fill` stands in columns that no source column maps to; an entry that a sparse row lacks is 0."""

    n_cols: int
    dtype: DType
    fill: int | float
    overflow: str
    overflow_value: int | float | None
    allow_float_rounding: bool

    def __init__(self, n_cols: int, dtype_: Any, *, fill: Any = 0, overflow: str = "error", overflow_value: Any = None, allow_float_rounding: bool = False):
        d = dtype(dtype_)
        if not isinstance(overflow, str):
            raise TypeError("overflow must be a string")
        policy = overflow.strip().lower()
        if policy not in OVERFLOW_POLICIES:
            raise ValueError(f"overflow must be one of {OVERFLOW_POLICIES}")
        if (policy == "use_value") != (overflow_value is not None):
            raise ValueError("overflow_value goes with overflow='use_value', and only with it")
        if not isinstance(allow_float_rounding, bool):
            raise TypeError("allow_float_rounding must be bool")
        values = {
            "n_cols": as_int(n_cols, "n_cols"), "dtype": d, "fill": normalize_fill(fill, d), "overflow": policy,
            "overflow_value": None if overflow_value is None else normalize_fill(overflow_value, d, "overflow_value"), "allow_float_rounding": allow_float_rounding,
        }
        for k, v in values.items():
            object.__setattr__(self, k, v)

    @property
    def row_nbytes(self) -> int:
        return self.n_cols * self.dtype.itemsize

    @property
    def row_stride_bytes(self) -> int:
        """A row's bytes in steps of 64."""
        return -(-self.row_nbytes // 64) * 64

    def as_dict(self) -> dict[str, Any]:
        return {**{k: v for k, v in asdict(self).items() if k != "dtype"}, "dtype": self.dtype.name}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> OutputSpec:
        return cls(d["n_cols"], d["dtype"], fill=d["fill"], overflow=d["overflow"], overflow_value=d["overflow_value"], allow_float_rounding=d["allow_float_rounding"])
