"""Served records in one of Spark's own bucketed tables: upserts that cost what the batch holds.

The table is bucketed and sorted by key. A batch is laid out by the same buckets and appended; of the
revisions that a key then has, readers take the newest, which needs no shuffle, as all of them lie
in one bucket. Telling inserts from updates shuffles the batch alone. A lookup reads the files of one
bucket, and of these the row groups that may hold the key. ``compact`` writes the newest revisions
into a table of their own, which then takes the place of the old one.

Two writers may append at the same time: nothing of either is lost, and the newest revision wins
whoever wrote it. A batch that is repeated after a failure changes nothing. Only :meth:`BucketedTable.compact`
wants to be alone, as it would miss what is appended meanwhile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import upsert as revisions

_FORMAT = "parquet"


@dataclass(frozen=True)
class BucketedTable:
    """``name`` in the session's catalog, its files under ``root``, a folder all executors can reach.

    ``key`` names the records, ``updated`` orders their revisions; of equal ones the larger hash of
    all columns wins. ``buckets`` is chosen once: about the rows expected over some millions.
    """

    spark: SparkSession
    name: str
    root: str
    key: str
    updated: str
    buckets: int = 64

    # ---- writing

    def _append(self, rows: DataFrame, table: str, folder: str) -> None:
        # Each task holds one bucket, so a bucket gets one file.
        (
            rows.repartition(self.buckets, self.key)
            .write.format(_FORMAT)
            .mode("append")
            .bucketBy(self.buckets, self.key)
            .sortBy(self.key)
            .option("path", f"{self.root}/{folder}")
            .saveAsTable(table)
        )

    def create(self, rows: DataFrame) -> BucketedTable:
        """A new table of the newest revisions among ``rows``."""
        self._append(self._newest(rows), self.name, "rows")
        return self

    def attach(self, schema: str) -> BucketedTable:
        """Names the files under ``root`` in the catalog of a new session; ``schema`` as DDL."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING {_FORMAT} CLUSTERED BY ({self.key}) "
            f"SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/rows'"
        )
        return self

    def classified(self, incoming: DataFrame) -> DataFrame:
        """The newest revision of each incoming key with ``change``: insert, update, or stale where the
        table has a newer one."""
        rows = self._newest(incoming).repartition(self.buckets, self.key)
        held = self.rows().groupBy(self.key).agg(F.max(self.updated).alias("_stored_at"), F.lit(True).alias("_hit"))
        # A revision without a time is older than any with one.
        older = F.coalesce(F.col(self.updated) < F.col("_stored_at"), F.col("_stored_at").isNotNull())
        change = (
            F.when(F.col("_hit").isNull(), "insert")
            .when(older, "stale")
            .otherwise("update")
        )
        return rows.join(held, self.key, "left").withColumn("change", change).drop("_hit", "_stored_at")

    def upsert(self, changes: DataFrame) -> None:
        """Appends what :meth:`classified` doesn't call stale; pass it written, as the table changes."""
        self._append(changes.where("change <> 'stale'").select(*self.rows().columns), self.name, "rows")

    def compact(self, into: str) -> BucketedTable:
        """The newest revisions as a table ``into`` with files of its own, one a bucket."""
        root = f"{self.root}/{into}"
        other = BucketedTable(self.spark, into, root, self.key, self.updated, self.buckets)
        other._append(self.newest(), into, "rows")
        return other

    # ---- reading

    def rows(self) -> DataFrame:
        """All revisions."""
        return self.spark.table(self.name)

    def _newest(self, rows: DataFrame) -> DataFrame:
        # Rows without a key name no record.
        rows = rows.where(F.col(self.key).isNotNull())
        order = [F.desc_nulls_last(self.updated), F.desc(F.xxhash64(*rows.columns))]
        return revisions.latest_revision(rows, [self.key], order)

    def newest(self) -> DataFrame:
        """The newest revision of each key, without a shuffle."""
        return self._newest(self.rows())

    def lookup(self, *keys) -> DataFrame:
        """The newest revisions of the keys; files of other buckets are not opened."""
        return self._newest(self.rows().where(F.col(self.key).isin(*keys)))

    def matching(self, other: BucketedTable, how: str = "inner") -> DataFrame:
        """The newest revisions joined by key with those of another table that has as many buckets,
        without a shuffle on either side."""
        mine, theirs = self.newest(), other.newest()
        return mine.join(theirs, mine[self.key] == theirs[other.key], how)
