"""Annotated containers: matrices by key, with tables of observations and variables.

Keys: X, layers/<name>, raw/X, obsm/<name>, obsp/<name>. obs and var are tables (pos, name, ...), as may be parts of
obsm, varm and varp; uns is JSON. Arrays of more dimensions are stored with the cells first and the rest flattened.

A container is a folder of versions ``ver-<id>``; the marker with the largest number names the current one (see fs).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import InvalidMetaError, UnsupportedError  # type: ignore[attr-defined]
from ..functions.types import dtype
from ..operators import names as name_tables
from ..operators.matrix import Matrix
from ..operators.names import as_str_tuple, build_feature_map, locate_names
from .fs import Files
from .options import ReadLimits
from .store import Store, open_store, write
from .zipio import container_folder, is_archive

ABOUT, FORMAT, VERSION = "_container.json", "matrixloom-container", 1
SLOTS = ("X", "layers", "raw", "obsm", "obsp", "obs", "var", "uns", "varm", "varp")


def normalize_key(key: str) -> str:
    """A relative key; strange parts are refused."""
    if not isinstance(key, str):
        raise TypeError("a key is a string")
    parts = key.strip("/").split("/")
    if "\\" in key or "\0" in key or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"bad key {key!r}")
    return "/".join(parts)


def resolve(spark: SparkSession, path: str) -> Files:
    """The folder of a store, or of a container's current version; an archive's contents where the path is a file."""
    files = Files(spark, str(path))
    if not files.exists():
        raise FileNotFoundError(path)
    if is_archive(spark, str(path)):
        files = Files(spark, container_folder(spark, str(path)))
        inside = [n for n, folder, _ in files.list() if folder]
        if len(inside) == 1 and not files.exists(ABOUT) and files.inside(inside[0]).exists(ABOUT):
            files = files.inside(inside[0])
    current = files.current()
    return files.inside(current) if current and current.startswith("ver-") else files


def list_keys(spark: SparkSession, path: str) -> list[str]:
    """Keys of all matrices, sorted; [""] for a bare store."""
    files = resolve(spark, path)
    if files.current():
        return [""]
    out = [k for k in ("X", "raw/X") if files.inside(k).current()]
    for slot in ("layers", "obsm", "obsp"):
        out += [f"{slot}/{n}" for n, folder, _ in files.list(slot) if folder and files.inside(f"{slot}/{n}").current()]
    return sorted(out)


def resolve_matrix_location(spark: SparkSession, path: str, key: str = "X") -> str:
    """Folder of a container's matrix, or of a bare store, for open_store."""
    files = resolve(spark, path)
    if files.current():
        return files.root
    key = normalize_key(key)
    if not files.inside(key).current():
        raise FileNotFoundError(f"{path} has no matrix {key!r}; there are {list_keys(spark, path)}")
    return files.at(key)


def feature_table(key: str) -> str | None:
    """The table that names a matrix's columns."""
    return "var" if key == "X" or key.startswith("layers/") else "raw/var" if key == "raw/X" else None


def name_table(spark: SparkSession, path: str, table: str | None) -> DataFrame | None:
    """(pos, name) of a container's table; only these columns are read."""
    files = resolve(spark, path)
    return spark.read.parquet(files.at(table)).select("pos", "name") if table and files.exists(table) else None


def _collected(table: DataFrame | None) -> tuple[str, ...] | None:
    return None if table is None else tuple(r.name for r in table.orderBy("pos").collect())


def read_feature_names(spark: SparkSession, path: str, key: str = "X") -> tuple[str, ...] | None:
    """Names of a matrix's columns, on the driver."""
    return _collected(name_table(spark, path, feature_table(normalize_key(key))))


def read_obs_names(spark: SparkSession, path: str) -> tuple[str, ...] | None:
    """Names of the rows, on the driver; name_table(spark, path, "obs") leaves them in Spark."""
    return _collected(name_table(spark, path, "obs"))


def normalize_feature_map(feature_map: Any, n_cols: int) -> tuple[int | None, ...] | None:
    """One target or None per column, targets unique."""
    if feature_map is None:
        return None
    out = tuple(None if v is None else int(v) for v in feature_map)
    if len(out) != n_cols:
        raise ValueError(f"the feature map has {len(out)} entries for {n_cols} columns")
    mapped = [v for v in out if v is not None]
    if any(v < 0 for v in mapped):
        raise ValueError("feature map targets must not be negative")
    if len(set(mapped)) != len(mapped):
        raise ValueError("feature map targets must be unique")
    return out


@dataclass(frozen=True)
class RowRef:
    source_id: int
    row: int


@dataclass(frozen=True)
class Dataset:
    """One matrix as a source for plans. Pickles by path and opens again where it is used.

    Names of columns are on the driver, as feature maps are. Names of rows stay a table unless they were given.
    """

    path: str
    key: str
    store: Store = field(compare=False, repr=False)
    feature_map: tuple[int | None, ...] | None = None
    feature_names: tuple[str, ...] | None = None
    given_names: tuple[str, ...] | None = None
    named: bool = False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "store"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise ValueError("no active session to open the dataset with")
        self.__dict__["store"] = open_store(spark, resolve_matrix_location(spark, self.path, self.key or "X"))

    @property
    def observations(self) -> DataFrame | None:
        """(pos, name) of the rows, or None where they have no names."""
        spark = self.matrix.spark
        if self.given_names is not None:
            return spark.createDataFrame(list(enumerate(self.given_names)), "pos long, name string")
        return name_table(spark, self.path, "obs") if self.named else None

    @property
    def obs_names(self) -> tuple[str, ...] | None:
        """The rows' names on the driver."""
        return self.given_names if self.given_names is not None else _collected(self.observations)

    @property
    def matrix(self) -> Matrix:
        return self.store.matrix

    @property
    def shape(self) -> tuple[int, int]:
        return self.matrix.shape

    n_rows = property(lambda self: self.shape[0])
    n_cols = property(lambda self: self.shape[1])
    dtype = property(lambda self: self.matrix.dtype)
    kind = property(lambda self: self.matrix.kind)
    var_names = property(lambda self: self.feature_names)

    def with_feature_map(self, feature_map: Iterable[int | None] | None) -> Dataset:
        return replace(self, feature_map=normalize_feature_map(feature_map, self.n_cols))

    def with_aligned_features(self, target_names: Iterable[str]) -> Dataset:
        if self.feature_names is None:
            raise ValueError("this dataset has no feature names")
        return self.with_feature_map(build_feature_map(self.feature_names, target_names))

    def rows_for(self, names: Iterable[str] | DataFrame, *, missing: str = "error") -> np.ndarray | DataFrame:
        """Rows of names, in their order: an array, or a table (pos, row) for a table (pos, name)."""
        if self.given_names is not None and not isinstance(names, DataFrame):
            return locate_names(self.given_names, names, missing=missing)
        known = self.observations
        if known is None:
            raise ValueError("this dataset has no observation names")
        if isinstance(names, DataFrame):
            return name_tables.locate(known, names, missing)
        if missing not in ("error", "drop"):
            raise ValueError("missing must be 'error' or 'drop'")
        asked = as_str_tuple(names, "names")
        table = self.matrix.spark.createDataFrame(list(enumerate(asked)), "pos long, name string")
        found = {r.pos: r.row for r in name_tables.locate(known, table, "drop").collect()}
        if missing == "error" and len(found) < len(asked):
            raise ValueError(f"name {next(n for i, n in enumerate(asked) if i not in found)!r} is not present")
        return np.array([found[i] for i in sorted(found)], np.uint64)

    def info(self) -> dict:
        return {"path": self.path, "key": self.key, "shape": self.shape, "dtype": self.dtype.name, "kind": self.kind, "mapped": self.feature_map is not None}

    def close(self) -> None:
        self.store.close()

    @property
    def closed(self) -> bool:
        return self.store.closed

    def __enter__(self) -> Dataset:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


def register(spark: SparkSession, source: str, *, key: str = "X", feature_map: Any = None, feature_names: Any = "auto", obs_names: Any = "auto", limits: ReadLimits | None = None, **overrides: Any) -> Dataset:
    """One matrix of a container, a bare store, or one in an archive of either, as a dataset."""
    source = str(source).rstrip("/")
    bare = bool(resolve(spark, source).current())
    key = "" if bare else normalize_key(key)
    store = open_store(spark, resolve_matrix_location(spark, source, key or "X"), limits=limits, **overrides)
    auto = lambda given: isinstance(given, str) and given == "auto"
    read = None if bare else read_feature_names(spark, source, key) if auto(feature_names) else None
    features = read if auto(feature_names) else None if feature_names is None else as_str_tuple(feature_names)
    observed = None if auto(obs_names) or obs_names is None else as_str_tuple(obs_names)
    table = name_table(spark, source, "obs") if auto(obs_names) and not bare else None
    n_rows, n_cols = store.meta["shape"]
    n_names = len(observed) if observed is not None else n_rows if table is None else table.count()
    if features is not None and len(features) != n_cols or n_names != n_rows:
        raise ValueError("names do not match the matrix's shape")
    return Dataset(source, key, store, normalize_feature_map(feature_map, n_cols), features, observed, table is not None)


def cell_axis(shape: tuple[int, ...], n_cells: int) -> int:
    """The axis of cells: the first, or else the last, of their length."""
    if shape and shape[0] == n_cells:
        return 0
    if shape and shape[-1] == n_cells:
        return -1
    raise ValueError(f"no axis of shape {shape} has {n_cells} cells")


def flatten_cells(array: np.ndarray, n_cells: int) -> tuple[np.ndarray, dict]:
    """(cells x rest, what restores it)."""
    axis = cell_axis(array.shape, n_cells)
    moved = array if axis == 0 else np.moveaxis(array, -1, 0)
    return moved.reshape(n_cells, -1), {"shape": list(array.shape), "cell_axis": axis}


def restore_cells(flat: np.ndarray, how: Mapping[str, Any]) -> np.ndarray:
    shape, axis = tuple(how["shape"]), how["cell_axis"]
    if axis == 0:
        return flat.reshape(shape)
    return np.moveaxis(flat.reshape(shape[-1], *shape[:-1]), 0, -1)


def unflatten(matrix: Matrix, how: Mapping[str, Any]) -> DataFrame:
    """(row, axis0, axis1, ..., value) of the cells of a flattened array: a row's column as places on the other axes."""
    shape = how["shape"][1:] if how["cell_axis"] == 0 else how["shape"][:-1]
    out, size = matrix.coo(), int(np.prod(shape))
    places = []
    for i, n in enumerate(shape):
        size //= max(n, 1)
        places.append(F.expr(f"cast(col div {max(size, 1)} % {max(n, 1)} as int)").alias(f"axis{i}"))
    return out.select("row", *places, "value")


def _slots(include: Iterable[str] | None, exclude: Iterable[str] | None) -> Callable[[str], bool]:
    for given in (include, exclude):
        if given is not None and (unknown := {s.split("/")[0] for s in given} - set(SLOTS)):
            raise ValueError(f"unknown slots {sorted(unknown)}")
    inside = lambda key, given: any(key == s or key.startswith(f"{s}/") or s.startswith(f"{key}/") for s in given)
    return lambda key: key in ("obs", "var") or (include is None or inside(key, include)) and (exclude is None or not any(key == s or key.startswith(f"{s}/") for s in exclude))


def _checked_parts(obs: DataFrame, var: DataFrame, matrices: Mapping[str, Any], raw_var: DataFrame | None, tables: Mapping[str, DataFrame]) -> tuple[dict, dict, dict, int]:
    """(tables, matrices, shapes of flattened arrays, cells), all checked before anything is written."""
    frames = {"obs": obs, "var": var, **({"raw/var": raw_var} if raw_var is not None else {}), **{normalize_key(k): t for k, t in tables.items()}}
    for k, frame in frames.items():
        if "pos" not in frame.columns or k in ("obs", "var", "raw/var") and "name" not in frame.columns:
            raise ValueError(f"{k} needs columns pos and name")
        if k.split("/")[0] not in SLOTS:
            raise ValueError(f"{k!r} is no place for a table")
    n_cells, n_features = obs.count(), var.count()
    prepared, shapes = {}, {}
    for k, m in {normalize_key(k): m for k, m in matrices.items()}.items():
        if not (k in ("X", "raw/X") or k.split("/")[0] in ("layers", "obsm", "obsp") and k.count("/") == 1):
            raise ValueError(f"{k!r} is no place for a matrix")
        dtype(m.dtype)
        if isinstance(m, np.ndarray) and m.ndim != 2:
            m, shapes[k] = flatten_cells(m, n_cells)
        wide = n_features if feature_table(k) == "var" else n_cells if k.startswith("obsp/") else m.shape[1]
        if tuple(m.shape) != (n_cells, wide):
            raise ValueError(f"{k} has shape {tuple(m.shape)} for {n_cells} observations and {n_features} variables")
        prepared[k] = m
    return frames, prepared, shapes, n_cells


def write_container(spark: SparkSession, path: str, *, obs: DataFrame, var: DataFrame, matrices: Mapping[str, Any], raw_var: DataFrame | None = None, tables: Mapping[str, DataFrame] | None = None, uns: Any = None, overwrite: bool = False, progress: Callable[[str, int, int], None] | None = None, **knobs: Any) -> list[str]:
    """Writes all parts as a new version, which counts when it is whole; older versions serve their readers on.

    obs and var are (pos, name, ...). matrices maps keys to matrices or arrays; a key's array of more than two
    dimensions is flattened with its cells first. tables maps keys such as obsm/<name> to tables (pos, ...).
    """
    files = Files(spark, str(path))
    frames, prepared, shapes, n_cells = _checked_parts(obs, var, matrices, raw_var, tables or {})
    about = json.dumps({"format": FORMAT, "version": VERSION, "cells": n_cells, "uns": uns, "shapes": shapes}, sort_keys=True)
    total = len(frames) + len(prepared)
    with files.new("ver", overwrite) as version:
        inside = files.inside(version)
        for i, (k, part) in enumerate([*frames.items(), *prepared.items()], 1):
            if k in frames:
                part.write.parquet(inside.at(k))
            else:
                write(spark, part, inside.at(k), **knobs).close()
            if progress:
                progress(k, i, total)
        inside.write(ABOUT, about)
    return sorted(prepared)


@dataclass(frozen=True)
class Container:
    """Lazy parts of a container: nothing is read until a matrix or table is used."""

    obs: DataFrame
    var: DataFrame
    matrices: dict[str, Store]
    tables: dict[str, DataFrame]
    uns: Any
    shapes: dict[str, dict]

    def array(self, key: str) -> np.ndarray:
        out = self.matrices[key].to_numpy()
        return restore_cells(out, self.shapes[key]) if key in self.shapes else out


def read_container(spark: SparkSession, path: str, *, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None, limits: ReadLimits | None = None) -> Container:
    """The chosen slots; obs and var always. Layout and shapes are checked, rows are read when they are used."""
    chosen, files = _slots(include, exclude), resolve(spark, path)
    if not files.exists("obs") or not files.exists("var"):
        raise FileNotFoundError(f"{path} has no obs and var")
    try:
        about = json.loads(files.read(ABOUT))
        cells, shapes, uns, known = about["cells"], about["shapes"], about["uns"], (about["format"], about["version"])
    except (FileNotFoundError, ValueError, KeyError, TypeError) as e:
        raise InvalidMetaError(f"{path}: {e}") from e
    if known != (FORMAT, VERSION):
        raise UnsupportedError(f"{path} has the layout {known}, not {(FORMAT, VERSION)}")
    read = lambda k: spark.read.parquet(files.at(k))
    matrices = {k: open_store(spark, files.at(k), limits=limits) for k in list_keys(spark, path) if chosen(k)}
    for k, m in matrices.items():
        if m.meta["shape"][0] != cells or k in shapes and int(np.prod(shapes[k]["shape"])) != int(np.prod(m.meta["shape"])):
            raise InvalidMetaError(f"{path}: {k} has shape {m.meta['shape']} for {cells} observations")
    tables = {k: read(k) for k in ("raw/var",) if files.exists(k) and chosen("raw")}
    for slot in ("obsm", "varm", "varp"):
        tables |= {f"{slot}/{n}": read(f"{slot}/{n}") for n, folder, _ in files.list(slot) if folder and chosen(f"{slot}/{n}") and not files.inside(f"{slot}/{n}").current()}
    return Container(read("obs"), read("var"), matrices, tables, uns if chosen("uns") else None, shapes)


def pack_container(spark: SparkSession, path: str, archive: str, **how: Any) -> list[str]:
    """A container's or store's current contents as an archive on the driver's disk."""
    from .zipio import pack

    return pack(path, archive, **how)
