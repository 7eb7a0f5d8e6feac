"""Small files and folders of a workspace, on whatever store its path names, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Existence, sizes and small text files below a path: local, HDFS or an object store alike."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name) if name else self.root

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def make(self) -> None:
        self.fs.mkdirs(self.root)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.root)) if self.exists() else []

    def size(self, name: str = "") -> int:
        """Bytes of a file, or of all below a folder."""
        return self.fs.getContentSummary(self._at(name)).getLength() if self.exists(name) else 0

    def read(self, name: str) -> str:
        with_stream = self.fs.open(self._at(name))
        try:
            return bytes(with_stream.readAllBytes()).decode()
        finally:
            with_stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file, under its name only when it is complete."""
        part = self._at(f".{name}.part")
        out = self.fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.fs.delete(self._at(name), False)
        self.fs.rename(part, self._at(name))
