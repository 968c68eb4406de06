"""Bucketed tables: what they hold, and the plans that make them worth it."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import upsert
from tidemark.plans import reports
from tidemark.sources.bucketed import BucketedTable

SCHEMA = "id string, at timestamp, price int"


def moment(day: int | None) -> datetime | None:
    return None if day is None else datetime(2024, 1, 1) + timedelta(days=day)


def frame(spark, rows):
    return spark.createDataFrame([(k, moment(d), p) for k, d, p in rows], SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    rows = [(f"k{i}", i % 7, i) for i in range(200)] + [("k1", 6, 999), ("k2", None, -1), (None, 1, 1)]
    name = "t" + uuid.uuid4().hex
    return BucketedTable(spark, name, str(tmp_path), "id", "at", 8).create(frame(spark, rows))


def held(df):
    return sorted((r.id, r.price) for r in df.collect())


def plan(df) -> str:
    """The plan before it is adapted at run time."""
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def apply(table, spark, tmp_path, rows):
    path = f"{tmp_path}/changes-{uuid.uuid4()}"
    table.classified(frame(spark, rows)).write.parquet(path)
    changes = spark.read.parquet(path)
    table.upsert(changes)
    return {r.id: r.change for r in changes.collect()}


BATCH = [("k3", 3, 1), ("k4", 90, 2), ("k5", 0, 3), ("new", 1, 4), ("new", 2, 5), ("later", None, 6), ("k6", None, 7)]


def test_an_upsert(spark, table, tmp_path):
    want = dict(held(table.newest()))
    assert len(want) == 200 and want["k1"] == 999 and want["k2"] == 2
    changes = apply(table, spark, tmp_path, BATCH)
    assert changes == {
        "k3": "update", "k4": "update", "k5": "stale", "new": "insert", "later": "insert", "k6": "stale"
    }
    assert dict(held(table.newest())) == want | {"k3": 1, "k4": 2, "new": 5, "later": 6}
    # The plain upsert says the same of all that have a time.
    timed = [r for r in BATCH if r[1] is not None]
    plain = upsert.latest_revision(frame(spark, timed), ["id"], [F.desc("at")])
    plain = upsert.classify_changes(frame(spark, [(f"k{i}", i % 7, i) for i in range(200)]), plain, "id", "at")
    assert {r.id: r.change for r in plain.collect()} == {k: c for k, c in changes.items() if k not in ("later", "k6")}


def test_a_repeated_batch_and_two_writers_change_nothing(spark, table, tmp_path):
    first, second = [("k9", 50, 1), ("a", 1, 1)], [("k9", 60, 2), ("b", 1, 1)]
    one, two = table.classified(frame(spark, first)), table.classified(frame(spark, second))
    for i, c in enumerate((one, two)):
        c.write.parquet(f"{tmp_path}/c{i}")
    for i in (1, 0, 0):  # the older revision is written last, and twice
        table.upsert(spark.read.parquet(f"{tmp_path}/c{i}"))
    got = dict(held(table.newest()))
    assert got["k9"] == 2 and got["a"] == got["b"] == 1


def test_plans_shuffle_the_batch_alone(spark, table, tmp_path):
    assert "Exchange" not in plan(table.newest())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(table.classified(frame(spark, BATCH)))
        assert text.count("Exchange hashpartitioning") >= 1
        # What lies between the join and the stored files holds no exchange.
        stored = text[text.rindex("Window [row_number()") if "Window [row_number()" in text else 0 :]
        assert "FileScan parquet" in text and "Exchange" not in stored.split("FileScan parquet")[0].split("Join")[-1]
        other = BucketedTable(spark, "t" + uuid.uuid4().hex, f"{tmp_path}/other", "id", "at", 8)
        other.create(frame(spark, [("k1", 1, 1), ("zz", 1, 1)]))
        joined = table.matching(other)
        assert "Exchange" not in plan(joined) and joined.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_lookup_reads_one_bucket(spark, table):
    found = table.lookup("k1")
    assert held(found) == [("k1", 999)]
    assert re.search(r"SelectedBucketsCount: 1 out of 8", plan(found))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(id,k1\)", plan(found))
    assert held(table.lookup("k1", "k2", "none")) == [("k1", 999), ("k2", 2)]


def test_a_new_session_and_compaction(spark, table, tmp_path):
    apply(table, spark, tmp_path, BATCH)
    whole = held(table.newest())
    spark.sql(f"DROP TABLE {table.name}")
    again = BucketedTable(spark, "t" + uuid.uuid4().hex, table.root, "id", "at", 8).attach(SCHEMA)
    assert held(again.newest()) == whole
    assert "SelectedBucketsCount: 1 out of 8" in plan(again.lookup("k1"))
    small = again.compact("c" + uuid.uuid4().hex)
    assert held(small.newest()) == whole == held(small.rows())
    assert "Exchange" not in plan(small.newest())


PAGE_SCHEMA = "unique_key string, created_date timestamp, is_duplicate_of string"


@pytest.mark.parametrize("size", [1, 3, 7])
def test_seeking_gives_the_pages_of_the_offset(spark, size):
    days = [3, 3, 3, 1, None, None, 2, 5, 5, None, 0]
    clean = spark.createDataFrame([(f"k{i}", moment(d), None) for i, d in enumerate(days)], PAGE_SCHEMA).cache()
    condition, last, n = reports.request_filter(), None, 0
    while True:
        page = [tuple(r) for r in reports.requests_after(clean, condition, last, size).collect()]
        want = [tuple(r) for r in reports.requests_page(clean, condition, size, n).collect()]
        assert page == want
        if not page:
            return
        n += len(page)
        key, created, _ = page[-1]
        last = (created.astimezone() if created else None, key)
