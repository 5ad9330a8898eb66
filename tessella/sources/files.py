"""Small files through Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession

from tessella.errors import Busy


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def ages(self, path: str) -> dict[str, float]:
        """Seconds since each entry of a folder was changed, by the store's clock as far as this machine's agrees."""
        p, fs = self._at(path)
        return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in fs.listStatus(p)} if fs.exists(p) else {}

    def size(self, path: str) -> int:
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def make(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)

    def rename(self, old: str, new: str) -> bool:
        a, fs = self._at(old)
        return fs.rename(a, self._at(new)[0])

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a new file; False if it exists. The text appears under its name only when it is complete."""
        import uuid

        p, fs = self._at(path)
        if fs.exists(p):
            return False
        draft = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p) or not fs.rename(draft, p):
            fs.delete(draft, False)
            return False
        return True


class State:
    """A JSON document with numbered versions; a new one must follow the one it was read from."""

    def __init__(self, files: Files, folder: str, keep: int = 20) -> None:
        self.files, self.folder, self.keep = files, folder, keep

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json") and n[:-5].isdigit()]

    def read(self, default: dict | None = None) -> tuple[int, dict]:
        found = self.versions()
        if not found:
            return 0, dict(default or {})
        return max(found), json.loads(self.files.read(f"{self.folder}/{max(found):012d}.json"))

    def retained(self) -> list[dict]:
        """All versions that are kept."""
        return [json.loads(self.files.read(f"{self.folder}/{v:012d}.json")) for v in self.versions()]

    def write(self, after: int, value: dict) -> int:
        """Publishes the version after the one read, or Busy if another writer did."""
        self.files.make(self.folder)
        if not self.files.create(f"{self.folder}/{after + 1:012d}.json", json.dumps(value, sort_keys=True)):
            raise Busy("another writer was faster")
        if after > self.keep and after % 8 == 0:
            for v in self.versions():
                if v <= after - self.keep:
                    self.files.delete(f"{self.folder}/{v:012d}.json")
        return after + 1
