"""A folder of numbered versions, each published by one rename."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class VersionLog:
    """Small JSON bodies under ``path``; the highest number is the current version.

    A body is written aside and renamed to the next number without overwriting,
    so a reader sees a whole version or none, and of two writers that start from
    the same version one fails. A body is an edit of the version before it: the
    names it holds replace those of the same name, and a null takes a name out. Every ``base_every`` versions a
    body is written out in full, so reading takes a bounded number of files and
    writing does not repeat what has not changed.
    """

    def __init__(self, spark: SparkSession, path: str, base_every: int = 50):
        self.path, self.base_every, self._jvm = path.rstrip("/"), base_every, spark._jvm
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _file(self, version: int) -> str:
        return f"{self.path}/{version:012d}"

    def versions(self) -> list[int]:
        """The numbers that are there, rising."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n) for n in names if n.isdigit())

    def current(self) -> int:
        """The current version; 0 before the first."""
        return max(self.versions(), default=0)

    def _body(self, version: int) -> dict:
        stream = self._fs.open(self._at(self._file(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> dict:
        """The state of a version, of the current one by default; empty for version 0."""
        at = self.current() if version is None else version
        edits = []
        while at:
            body = self._body(at)
            edits.append(body["set"])
            if body["full"]:
                break
            at -= 1
        state = {k: v for e in reversed(edits) for k, v in e.items()}
        return {k: v for k, v in state.items() if v is not None}

    def publish(self, base: int, changes: dict) -> int:
        """Make version ``base`` with ``changes`` version ``base + 1``."""
        final, full = self._file(base + 1), base % self.base_every == 0
        whole = {k: v for k, v in {**self.read(base), **changes}.items() if v is not None} if full else changes
        body = {"full": full, "set": whole}
        aside = f"{self.path}/.{base + 1}-{self._jvm.java.util.UUID.randomUUID()}"
        out = self._fs.create(self._at(aside), True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if self._fs.exists(self._at(final)) or not self._fs.rename(self._at(aside), self._at(final)):
            self._fs.delete(self._at(aside), False)
            raise RuntimeError(f"version {base + 1} was published by another writer")
        return base + 1

    def expire(self, keep_from: int) -> list[int]:
        """Remove the versions before the last full one at or before ``keep_from``; returns their numbers."""
        full = max((v for v in self.versions() if v <= keep_from and self._body(v)["full"]), default=0)
        gone = [v for v in self.versions() if v < full]
        for v in gone:
            self._fs.delete(self._at(self._file(v)), False)
        return gone


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint; another one after the checkpoint was lost."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()
