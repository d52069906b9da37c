"""Small files of a log, on any file system that Hadoop knows: read, list, and write once."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Exists(RuntimeError):
    """The file to be written is there already."""


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self.hadoop = self._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        top = self.hadoop.Path(root)
        self.fs = top.getFileSystem(conf)
        self.root = self.fs.makeQualified(top).toString()
        self.context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it isn't there."""
        if not self.exists(folder):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))]
        return sorted(n for n in found if not n.startswith("."))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> None:
        """The whole file at once, under a name that nobody has taken; raises Exists if somebody did."""
        own = self.path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        self.fs.mkdirs(own.getParent())
        out = self.fs.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        options = self._gateway.new_array(self.hadoop.Options.Rename, 1)
        options[0] = self.hadoop.Options.Rename.NONE
        try:
            self.context.rename(own, self.path(name), options)
        except Exception as error:
            self.fs.delete(own, False)
            if self.exists(name):
                raise Exists(name) from error
            raise

    def size(self, name: str) -> int:
        """Bytes of a file, or of all files of a folder."""
        return self.fs.getContentSummary(self.path(name)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
