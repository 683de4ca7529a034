"""Failures. Wrong calls raise TypeError, ValueError, IndexError or file errors; failures while running raise these."""

from __future__ import annotations

import warnings as _warnings


class Error(Exception):
    """Base of operational failures; ``kind`` is a stable name for programs."""

    kind = "error"


class Warning(UserWarning):  # noqa: A001
    """Base of this package's warnings."""


class PerformanceWarning(Warning):
    """Something works but slowly."""


#: Kinds of failure (fixed values); a class is made of each.
KINDS = (
    "invalid_argument", "invalid_input", "invalid_config", "invalid_dataset", "invalid_meta", "resource_limit", "stale_plan", "unsupported",
    "io", "json", "codec", "zip", "decode", "promotion", "conversion", "cancelled", "session", "worker_panic", "allocation", "internal",
    "not_found", "corrupt_data", "path",
)


def _named(kind: str) -> str:
    return "".join(p.title() for p in kind.split("_")) + "Error"


globals().update({_named(k): type(_named(k), (Error,), {"kind": k, "__module__": __name__, "__doc__": f"Failure of kind {k}."}) for k in KINDS})


def error_kind(exc: BaseException) -> str | None:
    kind = getattr(exc, "kind", None)
    return kind if isinstance(kind, str) else None


#: Marks in messages of expressions that fail while a job runs, and the errors they stand for.
GUARDS = {"[conversion]": "ConversionError", "[decode]": "DecodeError", "[corrupt]": "CorruptDataError"}


def from_spark(exc: BaseException) -> BaseException:
    """The failure that a guard expression raised inside a Spark job, or the exception itself."""
    text = str(exc)
    for mark, name in GUARDS.items():
        if mark in text:
            return globals()[name](text[text.index(mark) :].split("\n", 1)[0])
    return exc


def warn_slow(message: str) -> None:
    _warnings.warn(message, PerformanceWarning, stacklevel=3)
