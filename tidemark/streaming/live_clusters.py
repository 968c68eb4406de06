"""Clusters of repeated submissions while they arrive, as session windows with a watermark.

A cluster lives as keyed state from its first record until the watermark has passed its last one by
the window; then it is appended to the closed clusters and its state is dropped. So the state holds the
open clusters alone, whatever the length of the feed. What is still open can be read from the state.

A record older than the watermark is late: it is not counted here, and ``late_rows`` of a run says how
many there were. Linking takes late records all the same (:mod:`tidemark.operators.incremental`).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.duplicates import GROUP, _takes_part

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # A group with very many records sends one row a task and session into the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def clusters(
    records: DataFrame,
    window_minutes: int,
    delay: str,
    group: tuple[str, ...] = GROUP,
    time: str = "created_date",
    key: str = "unique_key",
) -> DataFrame:
    """Group, first_at, last_at, survivor (key of the first record, of ties the smallest) and members
    of each cluster; streams keep it open until the watermark, ``delay`` behind the newest time, has
    passed it. Records without group, key or time take no part."""
    part = records.where(_takes_part(group, time, key)).select(
        *group, F.col(time).cast("timestamp").alias("at"), F.col(key).cast("string").alias("key")
    )
    session = F.session_window("at", f"{window_minutes} minutes").alias("session")
    return (
        part.withWatermark("at", delay)
        .groupBy(*group, session)
        .agg(
            F.min(F.struct("at", "key")).alias("head"),
            F.max("at").alias("last_at"),
            F.count(F.lit(1)).alias("members"),
        )
        .select(*group, F.col("head.at").alias("first_at"), "last_at", F.col("head.key").alias("survivor"), "members")
    )


@dataclass(frozen=True)
class LiveClusters:
    """The closed clusters under ``root`` and the state of the open ones; ``root`` must be a folder
    that every executor can reach."""

    spark: SparkSession
    root: str
    window_minutes: int
    delay: str = "2 days"
    group: tuple[str, ...] = GROUP
    time: str = "created_date"
    key: str = "unique_key"

    def run(self, records: DataFrame) -> dict[str, int]:
        """Takes in what is new in the stream ``records``; gives rows read, late_rows and clusters open.

        A run that fails is repeated from the checkpoint by the next one; the sink's log keeps a
        batch from being appended twice.
        """
        found = clusters(records, self.window_minutes, self.delay, self.group, self.time, self.key)
        with state_settings(self.spark):
            stream = (
                found.writeStream.format("parquet")
                .option("path", f"{self.root}/closed")
                .option("checkpointLocation", f"{self.root}/checkpoint")
                .outputMode("append")
                .trigger(availableNow=True)
                .start()
            )
        stream.awaitTermination()
        progress = stream.recentProgress
        states = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
        return {
            "rows": sum(p["numInputRows"] for p in progress),
            "late_rows": sum(s["numRowsDroppedByWatermark"] for s in states),
            "open": states[-1]["numRowsTotal"] if states else 0,
        }

    def closed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/closed")

    def open(self) -> DataFrame:
        """The clusters that may still grow, from the state."""
        state = self.spark.read.format("statestore").load(f"{self.root}/checkpoint")
        head, last, count = (F.col("value")[c] for c in ("min", "max", "count"))
        # The state names the figures of the three aggregates by their functions.
        return state.select(
            *[F.col("value")[c].alias(c) for c in self.group],
            head["at"].alias("first_at"),
            last.alias("last_at"),
            head["key"].alias("survivor"),
            count.alias("members"),
        )

    def all(self) -> DataFrame:
        return self.closed().unionByName(self.open())
