"""Numbered commits on shared storage: the compare-and-swap that the ledger and the store rest on.

A commit is a small JSON file, written under another name and renamed to its number. The rename
never replaces a file (as on HDFS, where it is one atomic step of the name node), so of two writers
that start from the same commit one gets the number and the other is told to look again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    """``latest`` reads the newest commit; ``add`` appends the next one or reports that it is taken."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._file = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *[x for x in parts if x])))
        self._path = lambda *parts: self._file("_commits", *parts)
        self._fs = self._path().getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._keep = spark.sparkContext._gateway.new_array(kind, 1)
        self._keep[0] = kind.NONE
        self._taken = "FileAlreadyExistsException"

    def latest(self) -> tuple[int, dict | None]:
        """Number and content of the newest commit; (0, None) before the first."""
        at = self._path()
        if not self._fs.exists(at):
            return 0, None
        numbers = [int(n[:-5]) for s in self._fs.listStatus(at) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, None
        n = max(numbers)
        stream = self._fs.open(self._path(f"{n:012d}.json"))
        try:
            return n, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def add(self, number: int, content: dict) -> bool:
        """Appends commit ``number`` (the newest plus one); False if somebody else has it."""
        self._fs.mkdirs(self._path())
        new, to = self._path(f".{uuid.uuid4().hex}.tmp"), self._path(f"{number:012d}.json")
        out = self._fs.create(new, False)
        try:
            out.write(json.dumps(content).encode())
        finally:
            out.close()
        try:
            self._context.rename(new, to, self._keep)
        except Exception as e:
            self._fs.delete(new, False)
            if self._taken in str(getattr(e, "java_exception", e)):
                return False
            raise
        self._fs.delete(self._path(f"{number - 50:012d}.json"), False)  # old commits are history nobody reads
        return True

    def children(self, at: str) -> list[str]:
        """Names directly in a folder below the log's; none if there is no such folder."""
        path = self._file(at)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def remove(self, at: str) -> None:
        self._fs.delete(self._file(at), True)
