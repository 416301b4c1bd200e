"""Numbered versions of a folder, each a small JSON file, committed by one writer at a time.

A version is staged whole under another name and then renamed to its number, by a rename that fails where the number is taken. So a version
is either there as a whole or not at all, and of two writers one learns that it has to start again from the other's version. Writers of
a version first claim it, by creating a file that only one of them can create; the claim keeps the others waiting. A claim
whose writer seems lost is not taken away but outdone by one of the next epoch, which again only one of the waiters can create, and a writer looks for a later
epoch before it renames: one that was merely slow gives up. Works on every store that Hadoop's file systems
reach and whose create without overwrite is atomic.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: A claim without its version is taken for a lost writer's after this many seconds.
PATIENCE = 60.0
_WAIT = 0.2


class Versions:
    def __init__(self, spark: SparkSession, path: str, patience: float = PATIENCE):
        self.spark, self.path, self.patience = spark, path.rstrip("/"), patience
        self._jvm = spark.sparkContext._jvm
        self.hadoop_path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.hadoop_path(self.path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self.hadoop_path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        folder = self.hadoop_path(self.path)
        return [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []

    def numbers(self) -> list[int]:
        """Of all versions, ascending."""
        return sorted(int(n[:-5]) for n in self._names() if n.endswith(".json") and n[:-5].isdigit())

    def last(self) -> int:
        """The last version's number, 0 if there is none."""
        return max(self.numbers(), default=0)

    def read(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{version}.json", wholetext=True).first()[0])

    def _create(self, name: str, content: str) -> bool:
        try:
            out = self.fs.create(self._at(name), False)
        except Py4JJavaError:
            if self.fs.exists(self._at(name)):
                return False
            raise
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
        return True

    def _is_there(self, version: int) -> bool:
        return self.fs.exists(self._at(f"{version}.json"))

    def _epoch(self, version: int) -> int:
        """Of the last claim on the version, -1 if there is none."""
        prefix = f"{version}.claim-"
        return max((int(n[len(prefix) :]) for n in self._names() if n.startswith(prefix)), default=-1)

    def _claimed(self, version: int) -> int | None:
        """The epoch of this writer's claim, or None where the version has come; waits for another that is at it."""
        seen, waited = self._epoch(version), 0.0
        while True:
            if seen < 0 or waited >= self.patience:
                if self._create(f"{version}.claim-{seen + 1}", ""):
                    return seen + 1
            if self._is_there(version):
                return None
            time.sleep(_WAIT)
            found = self._epoch(version)
            seen, waited = (seen, waited + _WAIT) if found == seen else (found, 0.0)

    def _put(self, staged: str, version: int) -> bool:
        """Rename without overwriting."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(staged).toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(self._at(staged)), self.fs.makeQualified(self._at(f"{version}.json")), none)
        except Py4JJavaError:
            if self._is_there(version):
                return False
            raise
        return True

    def commit(self, base: int, content: dict) -> bool:
        """Make content version base + 1; False if there is such a version already, or another writer has taken over."""
        version, staged = base + 1, f"_{uuid.uuid4().hex}"
        self.fs.mkdirs(self.hadoop_path(self.path))
        epoch = self._claimed(version)
        if epoch is None:
            return False
        try:
            if self._is_there(version):
                return False
            self._create(staged, json.dumps({**content, "version": version}))
            return self._epoch(version) == epoch and self._put(staged, version)
        finally:
            self.fs.delete(self._at(staged), False)
            self.fs.delete(self._at(f"{version}.claim-{epoch}"), False)
            if self._is_there(version):  # claims that were outdone
                for k in range(epoch):
                    self.fs.delete(self._at(f"{version}.claim-{k}"), False)
