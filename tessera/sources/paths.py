"""Small files in whatever store the cluster's paths name, through Hadoop's file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Whole small files by path; a local path is a path of the default store's own kind."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def write(self, path: str, data: bytes) -> None:
        """Written aside and renamed, so that a reader never sees half a file."""
        fs, aside = self._fs(path), f"{path}._writing"
        out = fs.create(self._path(aside), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        fs.delete(self._path(path), False)
        if not fs.rename(self._path(aside), self._path(path)):
            raise OSError(f"{path} could not be written")

    def read(self, path: str) -> bytes:
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)
