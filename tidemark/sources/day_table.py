"""Records by day in one of Spark's own partitioned tables.

A batch overwrites the days it touches and no others (dynamic partition overwrite); retention drops
whole days from the catalog and rewrites the one day the cutoff falls into. Counts come from file
footers. Spark's commit protocol makes each write whole or not at all: a day is replaced when the job
has ended. There is one writer to a day at a time; writers of different days don't meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import timestamp_literal
from tidemark.sources.staging import written

PART = "part"


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass(frozen=True)
class DayTable:
    """Table ``name``, managed by the session's catalog in its warehouse, which all executors reach. ``part``,
    its last column, is the day of ``time`` (yyyy-MM-dd); records without a time have no day and are
    refused."""

    spark: SparkSession
    name: str
    time: str

    def create(self, schema: str) -> DayTable:
        self.spark.sql(f"CREATE TABLE {self.name} ({schema}, {PART} STRING) USING parquet PARTITIONED BY ({PART})")
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def of_days(self, days: list[str]) -> DataFrame:
        return self.rows().where(F.col(PART).isin(days))

    def days(self) -> list[str]:
        """Days that have files, from the catalog alone."""
        found = self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()
        return sorted(r.partition.split("=", 1)[1] for r in found)

    def replace_days(self, rows: DataFrame) -> None:
        """Puts ``rows`` in place of what their days held; a day without rows keeps what it has. The hint
        lets AQE split a day that is too large for one task."""
        dated = rows.where(F.col(self.time).isNotNull()).withColumn(PART, F.date_format(self.time, "yyyy-MM-dd"))
        laid = dated.select(*self.rows().columns).hint("rebalance", PART)
        with _settings(self.spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
            laid.write.insertInto(self.name, overwrite=True)

    def drop_days(self, days: list[str]) -> None:
        """Takes days off the table and deletes their files, unread."""
        if days:
            parts = ", ".join(f"PARTITION ({PART} = '{d}')" for d in days)
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {parts}")

    def prune(self, cutoff: datetime) -> int:
        """Deletes records older than ``cutoff``; gives how many. Days before it go unread, their counts
        come from footers; the day of the cutoff is written anew."""
        edge, moment = cutoff.strftime("%Y-%m-%d"), timestamp_literal(cutoff)
        old = [d for d in self.days() if d < edge]
        gone = sum(r["rows"] for r in self.counts().where(F.col(PART).isin(old)).collect()) if old else 0
        self.drop_days(old)
        if edge in self.days():
            day = self.of_days([edge])
            lost = day.where(F.col(self.time) < moment).count()
            left = day.where(F.col(self.time) >= moment)
            if lost and left.isEmpty():
                self.drop_days([edge])
            elif lost:
                # Written apart first: Spark doesn't overwrite what the same job reads.
                self.replace_days(written(left, "edge-day"))
            gone += lost
        return gone

    def counts(self) -> DataFrame:
        """part, rows: records of each day, from the footers of its files; no record is read."""
        days = self.days()
        if not days:
            return self.spark.createDataFrame([], f"{PART} string, rows bigint")
        root = self._location()
        with _settings(
            self.spark, spark__sql__sources__useV1SourceList="", spark__sql__parquet__aggregatePushdown="true"
        ):
            files = self.spark.read.schema(self.rows().schema).parquet(root)
            # Read while the settings hold: as many rows as there are days.
            found = files.groupBy(PART).agg(F.count(F.lit(1)).alias("rows")).collect()
        return self.spark.createDataFrame([(r[PART], r["rows"]) for r in found], f"{PART} string, rows bigint")

    def _location(self) -> str:
        told = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Location'").first()
        return told.data_type
