"""Small files through Hadoop's file system, so that any store Spark reads works for metadata too.

What a folder currently holds is told by the names of empty marker files: the largest number wins. Making a
marker is one atomic step, and no file is ever replaced, so a reader finds the old or the new contents whole.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

POINTER = re.compile(r"_CURRENT-([0-9]{12})-((?:gen|ver)-[0-9a-f]{32})")
FIRST = "_FIRST"


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()

    def at(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def inside(self, name: str) -> Files:
        return Files(self.spark, self.at(name))

    def both(self, name: str = ""):
        path = self._path(self.at(name))
        return path.getFileSystem(self._conf), path

    def exists(self, name: str = "") -> bool:
        fs, path = self.both(name)
        return fs.exists(path)

    def list(self, name: str = "") -> list[tuple[str, bool, int]]:
        """(name, is a folder, bytes) of the entries, sorted."""
        fs, path = self.both(name)
        return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def size(self, name: str) -> int:
        fs, path = self.both(name)
        if not fs.exists(path):
            raise FileNotFoundError(self.at(name))
        return fs.getFileStatus(path).getLen()

    def read(self, name: str) -> str:
        fs, path = self.both(name)
        if not fs.exists(path):
            raise FileNotFoundError(self.at(name))
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A new file; one that is there already is left alone and the call fails."""
        fs, path = self.both(name)
        stream = fs.create(path, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str = "") -> None:
        fs, path = self.both(name)
        fs.delete(path, True)

    # --- what the folder currently holds ---

    def pointers(self) -> list[tuple[int, str]]:
        return sorted((int(m[1]), m[2]) for n, _, _ in self.list() if (m := POINTER.fullmatch(n)))

    def current(self) -> str | None:
        found = self.pointers()
        return found[-1][1] if found else None

    @contextmanager
    def new(self, kind: str, overwrite: bool):
        """Name of a new folder inside, current once the block ends well and gone if it fails.

        A folder with other things in it is refused, and one with contents unless `overwrite` is given; without it,
        of several first writers one goes through.
        """

        def check() -> None:
            others = [n for n, _, _ in self.list() if n != name and not POINTER.fullmatch(n) and not n.startswith(("gen-", "ver-", FIRST))]
            if others:
                raise FileExistsError(f"{self.root} holds {others[0]}, which is nothing of this format")
            if not overwrite and self.pointers():
                raise FileExistsError(f"{self.root} already exists")

        name = f"{kind}-{uuid.uuid4().hex}"
        fs, path = self.both()
        if fs.exists(path) and not fs.getFileStatus(path).isDirectory():
            raise FileExistsError(f"{self.root} is a file")
        check()
        try:
            yield name
            check()  # others may have come meanwhile
            fs, first = self.both(FIRST)
            if not fs.createNewFile(first) and not overwrite:
                raise FileExistsError(f"{self.root} already exists")
            number = (self.pointers() or [(0, "")])[-1][0] + 1
            fs, marker = self.both(f"_CURRENT-{number:012d}-{name}")
            fs.create(marker, False).close()
        except BaseException:
            self.delete(name)
            if not self.list():
                self.delete()
            raise

    def expire(self) -> list[str]:
        """Deletes all contents but the current ones, with their markers."""
        found = self.pointers()
        for number, name in found[:-1]:
            self.delete(f"_CURRENT-{number:012d}-{name}")
            self.delete(name)
        return [name for _, name in found[:-1]]
