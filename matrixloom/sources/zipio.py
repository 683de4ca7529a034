"""Stores and containers in ZIP archives.

Spark reads files, not members of archives, so an archive is packed after writing, and its members are copied
once into the shared folder when it is opened; the driver streams them, and later opens find the copy. Stored
members hold Parquet files as they are.
"""

from __future__ import annotations

import hashlib
import os
import zipfile

from pyspark.sql import SparkSession

from ..functions.errors import ZipError, warn_slow  # type: ignore[attr-defined]
from ..operators.scratch import shared_folder
from .fs import POINTER, Files

DONE = "_UNPACKED"


def _safe(name: str) -> bool:
    parts = name.rstrip("/").split("/")
    return bool(name) and "\\" not in name and "\0" not in name and not name.startswith("/") and all(p not in ("", ".", "..") for p in parts) and len(name.encode()) < 1 << 16


def _checksum(name: str) -> bool:
    """Files that Hadoop's local file system keeps beside others."""
    return name.startswith(".") and name.endswith(".crc")


def _prefixes(names: list[str]) -> list[str]:
    """Sorted folders that hold a marker of a store; unsafe names are passed over."""
    return sorted({n.rpartition("/")[0] for n in names if _safe(n) and (m := POINTER.fullmatch(n.rpartition("/")[2])) and m[2].startswith("gen-")})


def list_stores(path: str) -> list[str]:
    """Sorted prefixes of the stores in an archive on the driver's disk."""
    with zipfile.ZipFile(path) as z:
        return _prefixes(z.namelist())


def _contents(folder: str) -> list[tuple[str, str]]:
    """(file, name inside) of what a store's or container's folder currently holds; older contents stay out."""
    found = sorted((int(m[1]), m[2], n) for n in os.listdir(folder) if (m := POINTER.fullmatch(n)))
    if not found:
        raise FileNotFoundError(f"{folder} holds no store")
    _, name, marker = found[-1]
    out = [] if name.startswith("ver-") else [(os.path.join(folder, marker), marker)]
    top = os.path.join(folder, name)
    for base, folders, names in os.walk(top):
        for n in (*folders, *names):
            if os.path.islink(os.path.join(base, n)):
                raise ValueError(f"{os.path.join(base, n)} is a link")
        for n in sorted(n for n in names if not _checksum(n)):
            full = os.path.join(base, n)
            out.append((full, os.path.relpath(full, folder if name.startswith("gen-") else top).replace(os.sep, "/")))
    return out


def pack(folder: str, archive: str, *, prefix: str = "", compression: int = zipfile.ZIP_STORED, overwrite: bool = False) -> list[str]:
    """Copies what a store's or container's folder holds into an archive. Links and name collisions are refused before anything is written."""
    if compression != zipfile.ZIP_STORED:
        warn_slow("compressed members are slower to read and hardly smaller: the data is compressed already")
    for base, folders, names in os.walk(folder):
        for n in (*folders, *names):
            if os.path.islink(os.path.join(base, n)):
                raise ValueError(f"{os.path.join(base, n)} is a link")
    members = [(full, "/".join(p for p in (prefix.strip("/"), inside) if p)) for full, inside in _contents(folder)]
    for _, inside in members:
        if not _safe(inside):
            raise ValueError(f"unsafe name {inside!r}")
    exists = os.path.exists(archive)
    if exists and not overwrite:
        with zipfile.ZipFile(archive) as z:
            if taken := set(z.namelist()) & {i for _, i in members}:
                raise FileExistsError(f"{archive} holds {sorted(taken)[0]} already")
    with zipfile.ZipFile(archive, "w" if overwrite or not exists else "a", compression) as z:
        for full, inside in members:
            z.write(full, inside)
    return [i for _, i in members]


def unpack(archive: str, folder: str, *, prefix: str | None = None) -> str:
    """Copies one store out of an archive on the driver's disk; the only one where no prefix is given. Returns its folder."""
    prefix = _chosen(archive, list_stores(archive), prefix)
    start = f"{prefix}/" if prefix else ""
    with zipfile.ZipFile(archive) as z:
        for n in z.namelist():
            if n.startswith(start) and _safe(n) and not n.endswith("/"):
                to = os.path.join(folder, n[len(start) :])
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with z.open(n) as a, open(to, "wb") as b:
                    while part := a.read(1 << 20):
                        b.write(part)
    return folder


def _chosen(archive: str, stores: list[str], prefix: str | None) -> str:
    if prefix is None:
        if len(stores) != 1:
            raise ValueError(f"{archive} holds {len(stores)} stores: {stores}")
        return stores[0]
    if prefix.strip("/") not in stores:
        raise FileNotFoundError(f"{archive}:{prefix}")
    return prefix.strip("/")


def is_archive(spark: SparkSession, path: str) -> bool:
    """Whether the path is a file; stores and containers are folders."""
    fs, at = Files(spark, path).both()
    return fs.exists(at) and not fs.getFileStatus(at).isDirectory()


def _copied(spark: SparkSession, archive: str) -> Files:
    """All safe members as files in the shared folder, copied by the JVM in a stream; named by the archive's path, size and time."""
    jvm, source = spark._jvm, Files(spark, archive)
    fs, path = source.both()
    status = fs.getFileStatus(path)
    name = hashlib.sha256(f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}".encode()).hexdigest()[:32]
    target = Files(spark, f"{shared_folder(spark)}/zip-{name}")
    if target.exists(DONE):
        return target
    stream = jvm.java.util.zip.ZipInputStream(fs.open(path))
    try:
        while (entry := stream.getNextEntry()) is not None:
            member = entry.getName()
            if entry.isDirectory() or not _safe(member) or _checksum(member.rpartition("/")[2]):
                continue
            out_fs, out = target.both(member)
            to = out_fs.create(out, True)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, to, 1 << 20, False)
            finally:
                to.close()
    except Exception as e:
        raise ZipError(f"{archive} cannot be read: {str(e).splitlines()[0]}") from e
    finally:
        stream.close()
    if not target.list():
        raise ZipError(f"{archive} is no archive, or an empty one")
    fs, done = target.both(DONE)
    fs.create(done, True).close()
    return target


def _stores_in(files: Files, prefix: str = "") -> list[str]:
    entries = files.list(prefix)
    if any(POINTER.fullmatch(n) for n, _, _ in entries):
        return [prefix]
    return [s for n, folder, _ in entries if folder for s in _stores_in(files, f"{prefix}/{n}".lstrip("/"))]


def unpacked(spark: SparkSession, archive: str, prefix: str | None) -> str:
    """Folder of one store of an archive."""
    files = _copied(spark, archive)
    return files.at(_chosen(archive, _stores_in(files), prefix))


def container_folder(spark: SparkSession, archive: str) -> str:
    """Folder of an archive's contents."""
    return _copied(spark, archive).root
