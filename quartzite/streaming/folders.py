"""Small files in a folder that driver and executors share, through Hadoop's file systems: written whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """Named texts in one folder. Only the driver uses it, for notes of what is committed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm, self.conf = spark, root.rstrip("/"), spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self) -> list[str]:
        """Names of what is there, hidden ones (of files that are being written) left out."""
        found = self.fs.listStatus(self._path("")) if self.exists() else []
        return sorted(n for n in (s.getPath().getName() for s in found) if n[0] not in "._")

    def text(self, name: str) -> str:
        source = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a text under a hidden name, then gives it its name; False if another has that already."""
        hidden = self._path(f".{uuid.uuid4().hex}")
        out = self.fs.create(hidden, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        fs = self.jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(hidden), self.fs.makeQualified(self._path(name)), none)
        except Exception as error:
            self.fs.delete(hidden, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
