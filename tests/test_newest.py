"""Newest revisions as stream state against the newest of all rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming.newest import NewestRevisions

SCHEMA = "id string, at timestamp, price int, note string"


def row(key: str | None, day: int | None, price: int | None, note: str | None = None) -> tuple:
    return key, datetime(2024, 1, 1) + timedelta(days=day) if day is not None else None, price, note


class Feed:
    def __init__(self, spark, root: str):
        self.spark, self.landing, self.batches = spark, f"{root}/landing", []
        self.newest = NewestRevisions(spark, f"{root}/newest", ("id",), "at", ("price", "note"))

    def send(self, rows: list[tuple]) -> dict[str, int]:
        self.spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(self.landing)
        return self.newest.run(
            self.spark.readStream.schema(SCHEMA).parquet(self.landing),
            lambda fresh, _: self.batches.append({tuple(r) for r in fresh.collect()}),
        )


def best(rows: list[tuple]) -> set[tuple]:
    low = lambda v: (v is not None, v if v is not None else 0)
    rank = lambda r: (low(r[1]), low(r[2]), (r[3] is not None, r[3] or ""))
    return {max((r for r in rows if r[0] == k), key=rank) for k in {r[0] for r in rows} - {None}}


def test_three_batches_with_stale_rows(spark, tmp_path):
    rng = random.Random(5)
    feed, sent = Feed(spark, str(tmp_path)), []
    for _ in range(3):
        rows = [
            row(rng.choice([None, *map(str, range(30))]), rng.choice([None, *range(8)]), rng.choice([None, 1, 2]), rng.choice([None, "x"]))
            for _ in range(60)
        ]
        before, sent = best(sent), sent + rows
        run = feed.send(rows)
        assert {tuple(r) for r in feed.newest.current().collect()} == best(sent)
        assert run["rows"] == 60
        # What a batch hands on is what it made newest, no stale and no repeated row.
        assert feed.batches[-1] == best(sent) - before and run["accepted"] == len(feed.batches[-1])


def test_stale_and_repeated_rows_are_refused(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    assert feed.send([row("a", 5, 1), row("a", 4, 9), row("b", None, 1)])["accepted"] == 2
    assert feed.send([row("a", 4, 7), row("a", 5, 1), row("b", None, 1), row(None, 9, 9)])["accepted"] == 0
    assert len(feed.batches) == 1
    assert feed.send([row("a", 6, 0), row("b", 0, 0)])["accepted"] == 2
    assert {r.id: r.price for r in feed.newest.current().collect()} == {"a": 0, "b": 0}


def test_a_batch_goes_into_the_state_once(spark, tmp_path):
    """Rows of a batch are read once, whatever is told about it and whoever takes the new revisions."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(key):
        read.add(1)
        return True

    rows = [row(str(n), 1, n) for n in range(20)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/landing")
    for name, accept in (("alone", None), ("handed on", lambda fresh, _: (fresh.count(), fresh.collect()))):
        before = read.value
        newest = NewestRevisions(spark, f"{tmp_path}/{name}", ("id",), "at", ("price", "note"))
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/landing").where(counted("id"))
        assert newest.run(stream, accept) == {"rows": 20, "accepted": 20}
        assert read.value - before == 20
