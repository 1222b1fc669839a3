"""Tables that grow by named commits: what is run twice is there once, and readers see whole commits only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """The tables below a folder, each commit's rows in a folder of their own, named by small numbered manifests.

    A commit writes its data first and then a manifest of all data there is; a
    rename to the next number makes it visible, and fails if that number has been
    taken meanwhile, so that the commit is tried again on what is newest. Data
    that no manifest names, of jobs that failed, are never read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self.path(f"{self.folder}/versions")
        if not self.files.exists(at):
            return []
        names = [x.getPath().getName() for x in self.files.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, number: int) -> dict[str, dict[str, str]]:
        """Table to commit name to data folder."""
        stream = self.files.open(self.path(f"{self.folder}/versions/{number:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict[str, dict[str, str]]]:
        numbers = self._numbers()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (0, {})

    def _publish(self, number: int, manifest: dict) -> bool:
        part = self.path(f"{self.folder}/versions/.{uuid.uuid4().hex}.part")
        stream = self.files.create(part, False)
        try:
            stream.write(json.dumps(manifest, sort_keys=True).encode())
        finally:
            stream.close()
        to = self.path(f"{self.folder}/versions/{number:010d}.json")
        if not self.files.exists(to) and self.files.rename(part, to):
            return True
        self.files.delete(part, False)
        return False

    def _write(self, df: DataFrame) -> str:
        data = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{data}")
        return data

    def commit(self, name: str, tables: dict[str, DataFrame], tries: int = 20) -> bool:
        """Add the rows of ``tables`` under ``name`` to all of them at once; False if a commit of that name is there already."""
        if any(name in commits for commits in self.newest()[1].values()):
            return False
        data = {table: self._write(df) for table, df in tables.items()}
        for _ in range(tries):
            number, manifest = self.newest()
            if any(name in commits for commits in manifest.values()):
                return False
            if self._publish(number + 1, manifest | {t: manifest.get(t, {}) | {name: at} for t, at in data.items()}):
                return True
        raise RuntimeError(f"{name} was overtaken {tries} times")

    def rewrite(self, change, tries: int = 5) -> int:
        """A new version in which ``change``, a function of the newest tables to new ones, replaces those it returns. The names of commits stay known."""
        for _ in range(tries):
            number, manifest = self.newest()
            made = change({t: self.read(t, number) for t in manifest})
            new = {t: dict.fromkeys(manifest[t], "") | {f"version {number + 1}": self._write(df)} for t, df in made.items()}
            if self._publish(number + 1, manifest | new):
                return number + 1
        raise RuntimeError(f"the tables changed {tries} times meanwhile")

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table in its newest version, or in an earlier one."""
        commits = (self.newest()[1] if version is None else self._manifest(version))[table]
        return self.spark.read.parquet(*[f"{self.folder}/{at}" for at in commits.values() if at])
