"""Objects of a store, through Spark's own file systems.

Small documents are read and written on the driver with the Hadoop file system that Spark has for the path; chunk
objects are read by the ``binaryFile`` source, so any store that Spark reads can hold arrays.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.errors import NodeExists, ResourceLimit

#: A listing of alternatives in a path pattern; an axis with more chunks is listed whole and filtered.
MAX_ALTERNATIVES = 256


class Store:
    """A folder in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(path).toString().rstrip("/")
        if self.fs.getScheme() == "file":
            self.fs = self.fs.getRawFileSystem()  # without checksum files beside the objects

    def path(self, key: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def exists(self, key: str) -> bool:
        return self.fs.exists(self.path(key))

    def read(self, key: str, max_bytes: int = 16 << 20) -> bytes | None:
        """A whole small object; ``None`` where there is none."""
        path = self.path(key)
        if not self.fs.exists(path) or self.fs.getFileStatus(path).isDirectory():
            return None
        if (n := self.fs.getFileStatus(path).getLen()) > max_bytes:
            raise ResourceLimit(f"bytes of {key}", max_bytes, n)
        stream = self.fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, key: str, data: bytes) -> None:
        """A new object; an existing one is an error."""
        path = self.path(key)
        if self.fs.exists(path):
            raise NodeExists(f"{key} exists")
        stream = self.fs.create(path, False)
        try:
            stream.write(data)
        finally:
            stream.close()

    def documents(self, names: Sequence[str], limit: int = 100_000) -> list[tuple[str, int]]:
        """(key, length) of all objects of these names below the root, found folder by folder.

        Folders of chunks are entered only where they are not purely numeric, so chunks of an array are not listed.
        """
        out, todo = [], [""]
        while todo:
            at = todo.pop()
            for s in self.fs.listStatus(self.path(at)):
                name = s.getPath().getName()
                key = f"{at}/{name}" if at else name
                if s.isDirectory():
                    if not name.isdigit() and not name.startswith(".staging-"):
                        todo.append(key)
                elif name in names:
                    out.append((key, s.getLen()))
                    if len(out) > limit:
                        raise ResourceLimit("listed documents", limit, len(out))
        return sorted(out)

    def objects(self, pattern: str) -> DataFrame | None:
        """``(key, length, content)`` of the objects that match a path pattern; ``None`` where none does.

        What is not selected is not read: without ``content`` this is a listing.
        """
        found = self.fs.globStatus(self.path(pattern))
        if not found:
            return None
        rows = self.spark.read.format("binaryFile").load(f"{self.root}/{pattern}")
        return rows.select(F.expr(f"substr(path, {len(self.root) + 2})").alias("key"), "length", "content")


def alternatives(values: Sequence[int], count: int) -> str:
    """One step of a path pattern."""
    return "*" if count > MAX_ALTERNATIVES else "{" + ",".join(map(str, values)) + "}"


def scratch(spark: SparkSession, prefix: str) -> str:
    """The folder that the session names for all executors; a temporary one only where all of them are on this machine."""
    if shared := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def settled(df: DataFrame) -> DataFrame:
    """Compute once, in the shared checkpoint folder that the session names."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch(df.sparkSession, "checkpoint-"))
    return df.checkpoint()
