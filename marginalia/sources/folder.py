"""Small files next to tables: on the local disk, or on any file system Spark knows."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def write_json(path: Path, data: dict) -> None:
    """Whole or not at all: a temporary file in the same folder, flushed, then renamed."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(data, f, indent=1, sort_keys=True)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


class Folder:
    """One folder by its path or URI; names are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = str(root).rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self.local = Path(self.root.removeprefix("file://")) if "://" not in self.root or self.root.startswith("file://") else None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _open(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        return p.getFileSystem(self._conf), p

    def names(self) -> list[str]:
        fs, p = self._open("")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, name: str) -> None:
        fs, p = self._open(name)
        fs.delete(p, True)

    def read(self, name: str) -> str | None:
        fs, p = self._open(name)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, data: dict) -> None:
        """Replaces a file as a whole: the rename is what makes the new content visible."""
        if self.local is not None:
            write_json(self.local / name, data)
            return
        fs, temporary = self._open(f".{name}.{os.getpid()}.tmp")
        stream = fs.create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(data, sort_keys=True).encode()))
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        target = self._jvm.org.apache.hadoop.fs.Path(self.path(name))
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(temporary, target, options)
