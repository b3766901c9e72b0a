"""Small files in folders that the cluster shares, through Hadoop's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class SharedFolder:
    """Whole small texts under one folder. A text appears at once, by a rename, or not at
    all, and never replaces one that is there."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}" if name else root)
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._to_text = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder, of files and folders; none where it is not there."""
        path = self._path(folder)
        if not self._files.exists(path):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(path)]
        return sorted(n for n in names if not n.startswith((".", "_")))

    def read(self, name: str) -> str:
        stream = self._files.open(self._path(name))
        try:
            return self._to_text(stream)
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        folder, _, last = name.rpartition("/")
        draft = self._path(f"{folder}/.{last}-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._files.exists(self._path(name)) or not self._files.rename(draft, self._path(name)):
            self._files.delete(draft, False)
            raise FileExistsError(name)

    def remove(self, name: str) -> None:
        """A file or a folder with all in it."""
        self._files.delete(self._path(name), True)
