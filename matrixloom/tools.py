"""Selections on arrays in memory with the keys of stored matrices."""

from __future__ import annotations

from typing import Any

import numpy as np

from .operators.axis import normalize_key
from .sources.options import as_int


class _Sliced:
    def __init__(self, array: Any):
        self.array = array

    def __getitem__(self, key: Any):
        rows, cols, one_row, one_col = normalize_key(key, *self.array.shape)
        if isinstance(self.array, np.ndarray):
            out = self.array[rows.positions()][:, cols.positions()]
            return out[0, 0] if one_row and one_col else out[0] if one_row else out[:, 0] if one_col else out
        out = self.array[rows.positions()][:, cols.positions()]
        return out[0, 0] if one_row and one_col else out


def slice(array: Any, *, num_workers: int = 1) -> _Sliced:  # noqa: A001
    """slice(a)[rows, cols] for two-dimensional arrays and scipy CSR matrices."""
    as_int(num_workers, "num_workers", 1)
    fmt = getattr(array, "format", None)
    if isinstance(array, np.ndarray) and array.ndim != 2 or fmt is not None and fmt != "csr":
        raise TypeError("expected a two-dimensional array or a CSR matrix")
    return _Sliced(array)
