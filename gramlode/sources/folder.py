"""Small driver-side helpers on a Hadoop file system: pointer files, listings, sizes."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A directory reachable through the session's Hadoop configuration."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path_class = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path_class(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path_class(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)))

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_text(self, name: str, text: str) -> None:
        """Write a new file in one step; fail when it already exists, also if another writer was faster.

        The text goes to a draft of its own, which then takes the name: by a hard link on a local disk, where a
        rename would replace a file, else by a rename, which a Hadoop file system refuses for a name in use.
        """
        if self.exists(name):
            raise FileExistsError(f"{self.path}/{name}")
        draft, target = self._at(f"{name}.{uuid.uuid4().hex}.draft"), self._at(name)
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            elif not self._fs.rename(draft, target):
                raise FileExistsError(f"{self.path}/{name}")
        finally:
            self._fs.delete(draft, False)

    def matching(self, pattern: str) -> list[str]:
        """Full paths of what matches a glob below the directory, sorted."""
        found = self._fs.globStatus(self._at(pattern))
        return sorted(s.getPath().toString() for s in found or [])

    def remove(self, name: str) -> None:
        """Delete a file or folder below the directory."""
        self._fs.delete(self._at(name), True)

    def size(self) -> int:
        """Bytes of all files below the directory."""
        return self._fs.getContentSummary(self._at("")).getLength() if self.exists() else 0

    def resolve(self) -> str:
        """Absolute, normalised path with its scheme."""
        return self._fs.makeQualified(self._at("")).toString()
