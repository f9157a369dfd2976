"""Several tables under one commit: each is written as a new version, and one small file, written last, names the versions that count."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed since the state was read; nothing of this write counts."""


class Commits:
    """The state of tables below a folder: commits/<number>.json, each with the folder of every table's version.

    A reader sees the tables of one commit. A writer that ends before its commit file stands leaves the old state, and two
    that began with the same commit can't both succeed: the file of the next number is created only where none is.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commit(self, number: int):
        return self._path(f"{self.path}/commits/{number:010d}.json")

    def latest(self) -> tuple[int, dict[str, str]]:
        """(number, table: folder) of the last commit; (0, {}) before the first."""
        where = self._path(f"{self.path}/commits")
        if not self._files.exists(where):
            return 0, {}
        names = sorted(s.getPath().getName() for s in self._files.listStatus(where))
        numbers = [int(n[:10]) for n in names if n.endswith(".json") and n[:10].isdigit()]
        if not numbers:
            return 0, {}
        text = self.spark.read.text(self._commit(numbers[-1]).toString(), wholetext=True).first()[0]
        return numbers[-1], json.loads(text)["tables"]

    def read(self, table: str, schema: str, at: dict[str, str] | None = None) -> DataFrame:
        """A table of the last commit, or of one that latest() told; without a version, no rows of the schema."""
        tables = self.latest()[1] if at is None else at
        return self.spark.read.parquet(f"{self.path}/{tables[table]}") if table in tables else self.spark.createDataFrame([], schema)

    def write(self, tables: dict[str, DataFrame], since: int) -> int:
        """Commit new versions of tables, the others staying as they were in commit `since`; returns its number."""
        number, old = self.latest()
        if number != since:
            raise Conflict(f"commit {number} stands where {since} was read")
        named = dict(old)
        for table, df in tables.items():
            named[table] = f"{table}/v={since + 1:010d}-{uuid.uuid4().hex}"
            df.write.mode("errorifexists").parquet(f"{self.path}/{named[table]}")
        return self._publish(since + 1, named)

    def _publish(self, number: int, named: dict[str, str]) -> int:
        target = self._commit(number)
        self._files.mkdirs(target.getParent())
        try:
            out = self._files.create(target, False)  # fails where a rival's file stands
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"commit {number} was written by another") from e
            raise
        try:
            out.write(bytearray(json.dumps({"number": number, "tables": named}, sort_keys=True).encode()))
        finally:
            out.close()
        return number

    def unused(self) -> list[str]:
        """Folders of versions that no commit names: what writers left that ended early or lost to a rival."""
        number, _ = self.latest()
        named = {f for k in range(1, number + 1) if self._files.exists(self._commit(k)) for f in json.loads(self.spark.read.text(self._commit(k).toString(), wholetext=True).first()[0])["tables"].values()}
        found = []
        for table in self._files.listStatus(self._path(self.path)) if self._files.exists(self._path(self.path)) else []:
            if table.isDirectory() and table.getPath().getName() != "commits":
                found += [f"{table.getPath().getName()}/{v.getPath().getName()}" for v in self._files.listStatus(table.getPath())]
        return sorted(set(found) - named)
