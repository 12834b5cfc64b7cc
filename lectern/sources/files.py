"""Small files in the cluster's shared folder, through the file system that the folder's address names.

Nothing here touches the driver's own disk, so plans, marks and manifests can lie wherever executors read and write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder on any file system that Spark can reach; names are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(self.at(name)))

    def names(self, name: str) -> list[str]:
        """Names in a subfolder, sorted; none if it does not exist."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.at(name))) if not s.getPath().getName().startswith((".", "_")))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _stage(self, content: dict) -> str:
        name = f".staged/{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(self.at(name)), True)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
            stream.hsync()
        finally:
            stream.close()
        return name

    def create(self, name: str, content: dict) -> bool:
        """Make a file that does not exist yet, in whole; false if another one was there first."""
        if self.exists(name):
            return False
        return self.move(self._stage(content), name)

    def replace(self, name: str, content: dict) -> None:
        """Put a file in the place of the one of that name; a reader sees the old or the new one."""
        staged, target = self._path(self.at(self._stage(content))), self._path(self.at(name))
        self.fs.mkdirs(target.getParent())
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(staged, target, overwrite)

    def move(self, name: str, to: str) -> bool:
        """Move a file or folder to a name that is free; false if it is taken."""
        target = self._path(self.at(to))
        self.fs.mkdirs(target.getParent())
        return not self.fs.exists(target) and self.fs.rename(self._path(self.at(name)), target)

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(self.at(name)), True)
