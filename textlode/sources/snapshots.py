"""Versions of a folder of tables: a reader sees one committed version, whole, whatever a writer does meanwhile.

    <path>/versions/000000000003     one file of JSON: what this version consists of
    <path>/data/<name>-<id>          tables; none is ever written twice

A writer writes its tables into new folders and then commits their names: the version file is written under
another name and renamed, which fails if another writer has taken the number. A writer that stops before that leaves
folders that no version names; `expire` removes them with those of old versions.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer has committed since this one read."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.at().getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def names(self, folder: str) -> list[str]:
        where = self.at(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def versions(self) -> list[int]:
        """Numbers of committed versions, in order."""
        return [int(n) for n in self.names("versions") if n.isdigit()]

    def load(self, version: int | None = None) -> tuple[int, dict]:
        """(number, content) of a version, the last if none is named; (0, {}) of a folder without any."""
        if version is None:
            version = max(self.versions(), default=0)
            if not version:
                return 0, {}
        stream = self.fs.open(self.at("versions", f"{version:012d}"))
        try:
            return version, json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def fresh(self, name: str) -> str:
        """A name for a new table's folder."""
        return f"{name}-{uuid.uuid4().hex}"

    def table(self, name: str) -> str:
        """Where the table of this name lies."""
        return f"{self.path}/data/{name}"

    def commit(self, content: dict, after: int) -> int:
        """Make this the version that follows `after`. content["tables"]: all names of tables that it needs."""
        draft = self.at("versions", f"_draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
            kind = self.jvm.org.apache.hadoop.fs.Options.Rename
            context.rename(draft, self.at("versions", f"{after + 1:012d}"), self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as error:
            self.fs.delete(draft, False)
            if "AlreadyExists" in str(error):
                raise CommitConflict(f"version {after + 1} is there already") from error
            raise
        return after + 1

    def expire(self, keep: int = 1) -> list[str]:
        """Remove all versions but the last `keep`, and the tables that none of those names; returns the tables removed.

        For one writer at a time: a table that is being written for a coming version is named by none. Readers of
        removed versions fail.
        """
        numbers = self.versions()
        left = numbers[-keep:]
        wanted = {t for n in left for t in self.load(n)[1].get("tables", [])}
        for n in numbers[: len(numbers) - len(left)]:
            self.fs.delete(self.at("versions", f"{n:012d}"), False)
        gone = [t for t in self.names("data") if t not in wanted]
        for t in gone:
            self.fs.delete(self.at("data", t), True)
        return gone
