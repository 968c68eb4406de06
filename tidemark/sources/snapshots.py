"""Stored tables as day-partitioned Parquet, several of them committed together.

A batch writes new files for the days it touches and never changes old ones. A commit record, one
line of JSON naming for every table the folders that make up each day, switches all tables at
once and carries the watermark, so data and watermark cannot part. A batch that dies before its
commit leaves only unreferenced files. Only days and folder numbers pass through the driver.
"""

from __future__ import annotations

import copy
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import STORED_TABLES

_EMPTY = {
    "version": 0,
    "watermark": None,
    "batches": {},
    "replays": 0,
    "replay_from": None,
    "next_run": 1,
    "frozen_days": [],
    "tables": {},
}


class SnapshotStore:
    """``root`` must be a folder every executor can reach. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- commits

    def head(self) -> dict:
        """The latest commit record. Commits are found by name; only the latest one is read."""
        try:
            files = self.spark.read.text(f"{self.root}/commits").inputFiles()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            files = []
        # A commit that was never finished has no file of its own yet.
        versions = [int(f.split("/version=")[1].split("/")[0]) for f in files]
        if not versions:
            return copy.deepcopy(_EMPTY)
        return json.loads(self.spark.read.text(self._commit(max(versions))).first()["value"])

    def _commit(self, version: int) -> str:
        return f"{self.root}/commits/version={version:09d}"

    def commit(self, head: dict, **changes) -> dict:
        """Writes the successor of ``head``; refuses a ``head`` that is no longer the latest.

        What a writer that died in mid-commit left in the successor's place is overwritten.
        """
        latest = self.head()["version"]
        if latest != head["version"]:
            raise ValueError(f"commit {latest} came after commit {head['version']}")
        record = copy.deepcopy(head) | changes | {"version": head["version"] + 1}
        (
            self.spark.range(1)
            .select(F.lit(json.dumps(record)).alias("value"))
            .coalesce(1)
            .write.mode("overwrite")
            .text(self._commit(record["version"]))
        )
        return record

    # ---- tables

    def days(self, head: dict, table: str) -> list[str]:
        return sorted(head["tables"].get(table, {}))

    def read(self, table: str, head: dict | None = None, days: list[str] | None = None) -> DataFrame:
        """A stored table, or only the given days of it; ``part`` is the day."""
        head = head or self.head()
        folders = head["tables"].get(table, {})
        wanted = folders if days is None else [d for d in days if d in folders]
        paths = [
            f"{self.root}/{table}/version={v}/part={d}" for d in wanted for v in folders[d]
        ]
        schema = f"{STORED_TABLES[table]}, version BIGINT, part STRING"
        if not paths:
            return self.spark.createDataFrame([], schema).drop("version")
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}")
        return reader.parquet(*paths).drop("version")

    def write_days(self, table: str, head: dict, rows: DataFrame) -> list[str]:
        """Writes rows for the version after ``head``, split by their ``part``; gives the days.

        The rebalance hint groups the rows by day and lets AQE split a day that is too large for
        one task. Overwriting makes a retried batch safe.
        """
        path = f"{self.root}/{table}/version={head['version'] + 1}"
        columns = [c.split()[0] for c in STORED_TABLES[table].split(",")]
        (
            rows.select(*columns, "part")
            .hint("rebalance", "part")
            .write.mode("overwrite")
            .partitionBy("part")
            .parquet(path)
        )
        # An empty result leaves no partition folders to read.
        written = self.spark.read.schema("part STRING").option("recursiveFileLookup", False).parquet(path)
        return [r["part"] for r in written.select("part").distinct().collect() if r["part"] is not None]

    def stage(self, name: str, head: dict, rows: DataFrame) -> DataFrame:
        """Writes intermediate rows of the next version once, for several readers."""
        path = f"{self.root}/staging/version={head['version'] + 1}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def vacuum(self) -> int:
        """Deletes the files no longer named by the latest commit; gives the number of folders."""
        head = self.head()
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        fs = jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(conf)

        def matches(pattern: str) -> list:
            found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}"))
            return [s.getPath() for s in (found or [])]

        live = {
            f"{table}/version={v}/part={d}"
            for table, days in head["tables"].items()
            for d, versions in days.items()
            for v in versions
        }
        doomed = [
            p
            for table in STORED_TABLES
            for p in matches(f"{table}/version=*/part=*")
            if "/".join(str(p.toString()).split("/")[-3:]) not in live
        ]
        doomed += [p for p in matches("staging/version=*")]
        doomed += [
            p for p in matches("commits/version=*") if int(p.getName().split("=")[1]) < head["version"]
        ]
        for p in doomed:
            fs.delete(p, True)
        return len(doomed)


def replaced(head: dict, table: str, old_days: list[str], new_days: list[str]) -> dict:
    """Day folders of a table after ``old_days`` gave way to ``new_days`` of the next version."""
    days = {d: v for d, v in head["tables"].get(table, {}).items() if d not in old_days}
    return days | {d: [head["version"] + 1] for d in new_days}


def appended(head: dict, table: str, new_days: list[str]) -> dict:
    days = dict(head["tables"].get(table, {}))
    return days | {d: days.get(d, []) + [head["version"] + 1] for d in new_days}
