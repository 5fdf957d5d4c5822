"""The few file operations that a table or a log needs, on any Hadoop file system.

All of them go through one object, so a test can put FaultyStorage in its
place and stop a program before or after any single one.

``publish`` must refuse a name that is taken, or two writers could both think
that they have won.  HDFS, ABFS and local file systems do so in one step.  On
S3 a rename is a copy behind a check: use a single writer there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class StorageError(OSError):
    """Base of the errors of this module."""


class NotFoundError(StorageError):
    """A file that is read is not there."""


class Storage:
    """Files below a root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, self._context = hadoop.Path, hadoop.FileContext
        self._overwrite = hadoop.Options.Rename.OVERWRITE
        self._fs = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def mkdirs(self, name: str) -> None:
        self._fs.mkdirs(self.at(name))

    def list(self, name: str) -> list[tuple[str, int]]:
        """(name, modification time in ms) of what a folder holds; nothing if it is not there."""
        if not self._fs.exists(self.at(name)):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(self.at(name))]

    def size(self, name: str) -> int:
        """Bytes stored below a name, from file metadata only."""
        return self._fs.getContentSummary(self.at(name)).getLength()

    def read(self, name: str) -> bytes:
        if not self._fs.exists(self.at(name)):
            raise NotFoundError(f"{self.root}/{name}")
        if not self.size(name):
            return b""  # Spark has no row for an empty file
        row = self.spark.read.format("binaryFile").load(f"{self.root}/{name}").select("content").first()
        return bytes(row[0])

    def _temporary(self, folder: str, data: bytes):
        path = self.at(f"{folder}/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(path, False)
        out.write(bytearray(data))
        out.close()
        return path

    def publish(self, name: str, data: bytes) -> bool:
        """A new file, whole or not at all; False if the name is taken."""
        temporary = self._temporary(name.rpartition("/")[0], data)
        if self._fs.exists(self.at(name)) or not self._fs.rename(temporary, self.at(name)):
            self._fs.delete(temporary, False)
            return False
        return True

    def replace(self, name: str, data: bytes) -> None:
        """A file with this content, whatever it held before."""
        temporary = self._temporary(name.rpartition("/")[0], data)
        context = self._context.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._overwrite
        context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(self.at(name)), options)

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def save(self, rows: DataFrame, name: str, **options: str) -> None:
        """A folder of Parquet files; readable once the job has committed."""
        rows.write.options(**options).parquet(f"{self.root}/{name}")


class CrashError(StorageError):
    """The fault that FaultyStorage was armed for."""


class FaultyStorage(Storage):
    """Counts the operations that change files, and fails at a given one.

    ``arm(n, done)`` makes the n-th from now fail, before it has any effect
    or, with ``done``, after all of it; every later one fails as well, as the
    program is dead then.  ``tear`` damages a file as a lost page would.
    """

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self.count, self._left, self._done = 0, None, False

    def arm(self, n: int, done: bool = False) -> None:
        self._left, self._done = n, done

    def _step(self, work):
        self.count += 1
        if self._left is not None:
            self._left -= 1
            if self._left < 0 or (self._left == 0 and not self._done):
                raise CrashError(f"stopped before operation {self.count}")
        out = work()
        if self._left == 0:
            raise CrashError(f"stopped after operation {self.count}")
        return out

    def mkdirs(self, name):
        return self._step(lambda: Storage.mkdirs(self, name))

    def publish(self, name, data):
        return self._step(lambda: Storage.publish(self, name, data))

    def replace(self, name, data):
        return self._step(lambda: Storage.replace(self, name, data))

    def delete(self, name):
        return self._step(lambda: Storage.delete(self, name))

    def save(self, rows, name, **options):
        return self._step(lambda: Storage.save(self, rows, name, **options))

    def tear(self, name: str, keep: int, flip: bool = False) -> None:
        """Leave ``keep`` bytes of a file, the last of them flipped if asked for."""
        data = bytearray(self.read(name)[:keep])
        if flip and data:
            data[-1] ^= 0xFF
        Storage.replace(self, name, bytes(data))
