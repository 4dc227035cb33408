"""Small files in the shared folder, through the file system that Spark uses for it."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """A folder in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, below: str = "") -> list[str]:
        """Names in a folder, in order; none where it doesn't exist."""
        at = self._path(below)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def put(self, name: str, text: str) -> None:
        """Writes a file so that it is there whole or not at all; what is there already stays."""
        if self.fs.exists(self._path(name)):
            return
        made = self._path(f"{name}.{self.jvm.java.util.UUID.randomUUID().toString()}.tmp")
        out = self.fs.create(made, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(made, self._path(name)):
            self.fs.delete(made, False)

    def get(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def move(self, name: str, to: str) -> None:
        if not self.fs.rename(self._path(name), self._path(to)):
            raise OSError(f"can't move {name} to {to} in {self.folder}")

    def stamp(self, name: str, millis: int) -> None:
        """Sets a file's time; where the file system keeps none of its own choice, this raises."""
        self.fs.setTimes(self._path(name), millis, -1)
        if self.fs.getFileStatus(self._path(name)).getModificationTime() != millis:
            raise OSError(f"{self.folder} keeps no times, so that a stream would take its files in any order")

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)
