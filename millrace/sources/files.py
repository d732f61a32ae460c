"""Files of any file system that Spark reaches."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

LISTING = "perms string, size long, date string, time string, path string"


@dataclass(frozen=True)
class Files:
    """Wrappers of Hadoop's FileSystem, on the driver.  Relative paths are below ``root`` if it is given."""

    spark: SparkSession
    root: str = ""

    def at(self, path: str) -> str:
        return path if not self.root or path.startswith("/") or "://" in path else f"{self.root.rstrip('/')}/{path}"

    def _open(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at(path))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._open(path)
        return fs.exists(p)

    def complete(self, path: str) -> bool:
        """Whether a job's output is there in whole; a plain file always is."""
        fs, p = self._open(path)
        return fs.exists(p) and (not fs.getFileStatus(p).isDirectory() or self.exists(f"{path}/_SUCCESS"))

    def delete(self, path: str) -> bool:
        fs, p = self._open(path)
        return fs.delete(p, True)

    def mkdir(self, path: str) -> None:
        fs, p = self._open(path)
        fs.mkdirs(p)

    def rename(self, source: str, target: str) -> bool:
        fs, p = self._open(source)
        fs.mkdirs(self._open(target)[1].getParent())
        return fs.rename(p, self._open(target)[1])

    def put(self, local: str, path: str) -> None:
        fs, p = self._open(path)
        fs.copyFromLocalFile(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(local), p)

    def get(self, path: str, local: str) -> None:
        fs, p = self._open(path)
        fs.copyToLocalFile(p, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(local))

    def chmod(self, path: str, mode: str) -> None:
        fs, p = self._open(path)
        fs.setPermission(p, self.spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission(mode))

    def cat(self, path: str) -> DataFrame:
        """Lines of text files, gunzipped by their extension."""
        return self.spark.read.option("lineSep", "\n").text(self.at(path))

    def ls(self, path: str, recursive: bool = False) -> DataFrame:
        """Files at a path, directory or glob: permissions, size, date, time, path."""
        from datetime import UTC, datetime

        fs, p = self._open(path)
        found = []
        for status in fs.globStatus(p) or []:
            if status.isDirectory():
                inside = fs.listFiles(status.getPath(), recursive)
                while inside.hasNext():
                    found.append(inside.next())
            else:
                found.append(status)
        rows = []
        for s in found:
            when = datetime.fromtimestamp(s.getModificationTime() / 1000, UTC)
            rows.append((s.getPermission().toString(), s.getLen(), f"{when:%Y-%m-%d}", f"{when:%H:%M}", s.getPath().toString()))
        return self.spark.createDataFrame(rows, LISTING)

    def fresh(self, prefix: str = "tmp") -> str:
        """A path that nothing has yet."""
        return self.at(f"{prefix}/{uuid.uuid4().hex}")
