"""The newest revision of each key as stream state, so that stale rows are refused before any table is read.

The state is a keyed aggregate without expiry, in RocksDB on the executors' disks: of each key the
row with the largest update time. Rows are stamped with the time of their micro-batch, which a replay
finds in the log again. A key that a batch touched comes out with its newest row; if that row
carries the stamp of this batch it is a new revision, if not all the batch had for the key was stale.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.staging import written
from tidemark.streaming.live_clusters import state_settings


@dataclass(frozen=True)
class NewestRevisions:
    """State under ``root``, a folder all executors can reach. ``columns`` are kept of each row beside
    ``keys`` and ``updated``; of equal update times the larger columns win, in their order. Rows without
    a key are refused; one without an update time only stands until any other comes."""

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    updated: str
    columns: tuple[str, ...]

    def _newest(self, rows: DataFrame) -> DataFrame:
        keyed = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys))
        # Structs are compared field by field with nulls first; the earliest stamp of equal rows is the
        # larger, so a row that comes again isn't new.
        stamped = keyed.select(
            *self.keys,
            F.struct(
                F.col(self.updated).alias("updated"),
                *[F.col(c).alias(f"c{i}") for i, c in enumerate(self.columns)],
                (-F.unix_micros(F.current_timestamp())).alias("stamp"),
            ).alias("_ranked"),
        )
        return stamped.groupBy(*self.keys).agg(F.max("_ranked").alias("newest"))

    def _named(self, state: DataFrame, newest: str, keys: dict[str, str]) -> DataFrame:
        top = F.col(newest)
        return state.select(
            *[F.col(v).alias(k) for k, v in keys.items()],
            top["updated"].alias(self.updated),
            *[top[f"c{i}"].alias(c) for i, c in enumerate(self.columns)],
        )

    def run(self, rows: DataFrame, accept: Callable[[DataFrame, int], None] | None = None) -> dict[str, int]:
        """Takes in what is new in the stream ``rows``; ``accept`` gets the new revisions of each batch and
        its number, which a batch repeated after a failure has again. Gives rows read and revisions accepted."""
        counted = {"accepted": 0}

        def each(touched: DataFrame, number: int) -> None:
            # All new rows of a batch have its stamp, which is the latest there is. Each look at the batch
            # takes its rows into the state again, so there is one, and ``accept`` reads what that wrote.
            fresh = touched.where(F.col("newest.stamp") <= -batch_time(number))
            if accept:
                fresh = written(fresh, "revisions")
            new = fresh.count()
            counted["accepted"] += new
            if accept and new:
                accept(self._named(fresh, "newest", {k: k for k in self.keys}), number)

        last: dict[int, int] = {}

        def batch_time(number: int) -> int:
            if number not in last:
                text = self.spark.read.text(f"{self.root}/checkpoint/offsets/{number}")
                line = text.where(F.col("value").contains("batchTimestampMs")).select(
                    F.get_json_object("value", "$.batchTimestampMs").cast("bigint").alias("ms")
                )
                last[number] = line.first().ms * 1000
            return last[number]

        with state_settings(self.spark):
            stream = (
                self._newest(rows)
                .writeStream.foreachBatch(each)
                .option("checkpointLocation", f"{self.root}/checkpoint")
                .outputMode("update")
                .trigger(availableNow=True)
                .start()
            )
        stream.awaitTermination()
        return {"rows": sum(p["numInputRows"] for p in stream.recentProgress), **counted}

    def current(self) -> DataFrame:
        """The newest revision of each key, read from the state."""
        state = self.spark.read.format("statestore").load(f"{self.root}/checkpoint")
        return self._named(state, "value.max", {k: f"key.{k}" for k in self.keys})
