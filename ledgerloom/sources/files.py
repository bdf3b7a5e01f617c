"""Small files and moves on whatever file system a path names: local, or the one that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Hadoop paths through the session; a path without a scheme is on the session's default file system, as it is for reads and writes of tables."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_folder(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def modified(self, path: str) -> int | None:
        """When the file or folder was written, in milliseconds; None where there is none."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The whole text or the former file: written beside it, closed, then moved."""
        fs, p = self._at(path)
        other = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{p.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(other, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            stream.hsync()
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        replace = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(other), fs.makeQualified(p), replace)

    def move(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        if not fs.exists(p):
            raise FileNotFoundError(source)
        t = self._jvm.org.apache.hadoop.fs.Path(target)
        if fs.exists(t):
            raise FileExistsError(target)
        fs.mkdirs(t.getParent())
        self._move(fs, p, t)

    def _move(self, fs, source, target) -> None:
        if not fs.rename(source, target):
            raise OSError(f"cannot move {source} to {target}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none where it is missing."""
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def files(self, folder: str) -> list[tuple[str, int]]:
        """(path below ``folder``, bytes) of all files in it, sorted."""
        fs, p = self._at(folder)
        if not fs.exists(p):
            return []
        root, found, each = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/", [], fs.listFiles(p, True)
        while each.hasNext():
            s = each.next()
            found.append((s.getPath().toUri().getPath().removeprefix(root), s.getLen()))
        return sorted(found)

    def sha256(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()
