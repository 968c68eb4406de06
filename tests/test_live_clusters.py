"""Clusters counted by a stream against clusters of everything."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from tidemark.operators import duplicates
from tidemark.streaming.live_clusters import LiveClusters

SCHEMA = "unique_key string, complaint_type_norm string, address_norm string, created_date timestamp"
START = datetime(2024, 3, 1)


def row(key: str, minutes: float | None, kind: str | None = "a", address: str | None = "x") -> tuple:
    return key, kind, address, START + timedelta(minutes=minutes) if minutes is not None else None


class Feed:
    def __init__(self, spark, root: str, delay: str = "3 hours"):
        self.spark, self.landing = spark, f"{root}/landing"
        self.live = LiveClusters(spark, f"{root}/live", 60, delay)

    def send(self, rows: list[tuple]) -> dict[str, int]:
        self.spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(self.landing)
        return self.live.run(self.spark.readStream.schema(SCHEMA).parquet(self.landing))


def told(df) -> set[tuple]:
    columns = ("complaint_type_norm", "address_norm", "first_at", "last_at", "survivor", "members")
    return {tuple(r[c] for c in columns) for r in df.collect()}


def of_everything(spark, rows: list[tuple]) -> set[tuple]:
    out, links = {}, duplicates.mark_duplicates(spark.createDataFrame(rows, SCHEMA), 60).collect()
    for r in links:
        if all((r.complaint_type_norm, r.address_norm, r.created_date, r.unique_key)):
            out.setdefault((r.complaint_type_norm, r.address_norm, r.is_duplicate_of or r.unique_key), []).append(r)
    return {
        (kind, address, min(r.created_date for r in rs), max(r.created_date for r in rs), survivor, len(rs))
        for (kind, address, survivor), rs in out.items()
    }


def test_batches_in_any_order_within_the_delay(spark, tmp_path):
    rng = random.Random(4)
    sent = [row(f"{i}", 7 * i + rng.randint(-80, 80), rng.choice("ab"), rng.choice(["x", "y"])) for i in range(200)]
    odd = [row("none", None), row("bare", 5, None), row("blank", 5, "a", ""), row("twice", 10), row("twice", 10)]
    sent = odd + sent
    feed = Feed(spark, str(tmp_path))
    for at in range(0, len(sent), 70):
        assert feed.send(sent[at : at + 70])["late_rows"] == 0
    assert told(feed.live.all()) == of_everything(spark, sent)
    assert told(feed.live.closed()) and told(feed.live.open())


def test_the_window_itself_links_and_closes(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.send([row("1", 0), row("2", 60)])
    assert {r[4:] for r in told(feed.live.all())} == {("1", 2)}
    run = feed.send([row("3", 60 + 60 + 1), row("far", 2000)])
    assert run["open"] == 1
    assert {r[4:] for r in told(feed.live.closed())} == {("1", 2), ("3", 1)}
    assert {r[4:] for r in told(feed.live.open())} == {("far", 1)}


def test_late_rows_are_told_and_change_nothing(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.send([row("1", 0), row("far", 2000)])
    before = told(feed.live.all())
    assert feed.send([row("late", 30)])["late_rows"] == 1
    assert told(feed.live.all()) == before
    assert feed.send([row("within the delay", 1999)])["late_rows"] == 0
    assert ("within the delay", 2) in {r[4:] for r in told(feed.live.open())}


def test_a_run_without_news(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.send([row("1", 0)])
    before = told(feed.live.all())
    feed.live.run(spark.readStream.schema(SCHEMA).parquet(feed.landing))
    assert told(feed.live.all()) == before
