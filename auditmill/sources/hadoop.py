"""File operations in whatever store a path is."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """A few Hadoop file operations below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self.at().getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *more: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *more]))

    def exists(self, *more: str) -> bool:
        return self.fs.exists(self.at(*more))

    def drop(self, *more: str) -> None:
        self.fs.delete(self.at(*more), True)

    def sizes(self, *more: str) -> dict[str, int]:
        """Names below the path, sorted, and their bytes."""
        return dict(sorted((x.getPath().getName(), x.getLen()) for x in self.fs.listStatus(self.at(*more)))) if self.exists(*more) else {}

    def names(self, *more: str) -> list[str]:
        return list(self.sizes(*more))

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.at(new).getParent())
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"cannot move {old} to {new}")

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _own(self, name: str, text: str) -> str:
        """A file of this text beside name, under a name of its own."""
        self.fs.mkdirs(self.at(name).getParent())
        own = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}".lstrip("/")
        stream = self.fs.create(self.at(own), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return own

    def write(self, name: str, text: str) -> None:
        """A file of this text; it comes by rename and is never half there."""
        self.move(self._own(name, text), name)

    def publish(self, name: str, text: str) -> bool:
        """A whole file of this text, if there is none of this name; of several callers at one time one gets True.

        A distributed file system's rename refuses a name that is taken. A local one's takes it, so there the name is linked."""
        own = self._own(name, text)
        try:
            if self.fs.getScheme() == "file":
                try:
                    self.jvm.java.nio.file.Files.createLink(*(self.jvm.java.io.File(self.at(x).toUri().getPath()).toPath() for x in (name, own)))
                    return True
                except Py4JJavaError as e:
                    if "FileAlreadyExistsException" not in str(e.java_exception):
                        raise
                    return False
            return bool(not self.exists(name) and self.fs.rename(self.at(own), self.at(name)))
        finally:
            self.drop(own)


class Conflict(RuntimeError):
    """Others changed a table again and again while a change was under way."""


def lines(rows: list[dict]) -> str:
    return "".join(json.dumps(r) + "\n" for r in rows)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: the session's spark.checkpoint.dir, or where a local session has none, a temporary one.
    What lies there goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="auditmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    made = f"{path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append(Files(spark, made))
    return made


_made: list[Files] = []


def _clean() -> None:
    for files in _made:
        try:
            files.fs.delete(files.at(), True)
        except Exception:  # noqa: BLE001 - the gateway may be gone at exit
            return
