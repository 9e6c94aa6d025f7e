"""Tables and models published as whole versions.

A store is a folder with a folder for every version and numbered pointer files.  A
version is written under a name of its own, and only when it is whole a pointer
with the next number is created, which fails if that number is taken.  The
pointer with the largest number names the current version.  So a writer that dies leaves the
store as it was, readers never see a part, and of two writers that build
the first version one wins and both use it.  Old versions stay for those who read them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

VERSIONS, POINTERS = "versions", "pointers"


class Published:
    """A store of versions at ``path``, on any file system that Spark's settings know."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    # ---- pointers --------------------------------------------------------------
    def _numbers(self) -> list[int]:
        folder = self._path(POINTERS)
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, number: int) -> str:
        stream = self._fs.open(self._path(POINTERS, f"{number:012d}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _point(self, number: int, version: str) -> bool:
        """Create a pointer; False if its number is taken."""
        target = self._path(POINTERS, f"{number:012d}")
        try:
            stream = self._fs.create(target, False)  # fails if it exists
        except Py4JJavaError as exc:
            if "AlreadyExists" in exc.java_exception.getClass().getName() or self._fs.exists(target):
                return False
            raise
        try:
            stream.write(bytearray(version.encode()))
        finally:
            stream.close()
        return True

    def current(self) -> str | None:
        """The folder of the current version; None if there is none."""
        for number in reversed(self._numbers()):
            name = self._read(number)
            if name.endswith("."):  # written to its end
                return "/".join([self.path, VERSIONS, name[:-1]])
        return None

    # ---- writing ------------------------------------------------------------------
    def _write(self, write: Callable[[str], object]) -> str:
        name = uuid.uuid4().hex
        write("/".join([self.path, VERSIONS, name]))
        return name

    def publish(self, write: Callable[[str], object]) -> str:
        """``write`` a new version into the folder it is given, then make it the current one."""
        name = self._write(write)
        while not self._point(max(self._numbers(), default=-1) + 1, name + "."):
            pass  # another writer took the number: the next one
        return "/".join([self.path, VERSIONS, name])

    def open_or_publish(self, write: Callable[[str], object]) -> str:
        """The current version, or the first one: that of whichever writer ends first."""
        found = self.current()
        if found is not None:
            return found
        name = self._write(write)
        self._point(0, name + ".")
        return self.current() or self.publish(write)


def open_or_build_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """S04 on a store: the current version of a table, or the one built now."""
    return spark.read.parquet(Published(spark, path).open_or_publish(lambda folder: build().write.parquet(folder)))


def publish_table(df: DataFrame, path: str) -> DataFrame:
    """A new version of a table; readers of the version before go on with it."""
    spark = df.sparkSession
    return spark.read.parquet(Published(spark, path).publish(lambda folder: df.write.parquet(folder)))
