"""Day tables: what a batch and retention change, and what they leave alone."""

from __future__ import annotations

import glob
import os
import uuid
from datetime import datetime, timedelta

import pytest

from tidemark.sources.day_table import DayTable

SCHEMA = "id STRING, at TIMESTAMP"
START = datetime(2024, 1, 1)


def hourly(spark, first: int, end: int, mark: str = ""):
    rows = [(f"{i}{mark}", START + timedelta(hours=i)) for i in range(first, end)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def table(spark):
    made = DayTable(spark, "d" + uuid.uuid4().hex, "at").create(SCHEMA)
    yield made
    spark.sql(f"DROP TABLE {made.name}")


def held(table) -> dict[str, int]:
    return {r.part: r.rows for r in table.counts().collect()}


def files(table) -> dict[str, float]:
    root = table._location().removeprefix("file:")
    return {f: os.path.getmtime(f) for f in glob.glob(f"{root}/part=*/*.parquet")}


def test_an_empty_table(spark, table):
    assert table.days() == [] and table.counts().count() == 0 and table.prune(START) == 0
    table.replace_days(hourly(spark, 0, 0))
    assert table.rows().count() == 0


def test_a_batch_touches_its_days_alone(spark, table):
    table.replace_days(hourly(spark, 0, 72).unionByName(spark.createDataFrame([("none", None)], SCHEMA)))
    before = files(table)
    assert held(table) == {"2024-01-01": 24, "2024-01-02": 24, "2024-01-03": 24}
    table.replace_days(hourly(spark, 30, 35, "new"))
    assert held(table) == {"2024-01-01": 24, "2024-01-02": 5, "2024-01-03": 24}
    after = files(table)
    assert all(after.get(f) == t for f, t in before.items() if "2024-01-02" not in f)
    assert {r.id for r in table.of_days(["2024-01-02"]).collect()} == {f"{i}new" for i in range(30, 35)}


def test_retention_drops_days_and_cuts_one(spark, table):
    table.replace_days(hourly(spark, 0, 96))
    size = sum(map(os.path.getsize, files(table)))
    kept = {f: t for f, t in files(table).items() if "01-04" in f}
    assert table.prune(START + timedelta(hours=53)) == 53
    assert held(table) == {"2024-01-03": 19, "2024-01-04": 24}
    assert {f: t for f, t in files(table).items() if "01-04" in f} == kept
    assert sum(map(os.path.getsize, files(table))) < size
    assert table.prune(START + timedelta(hours=53)) == 0
    assert table.prune(START + timedelta(hours=72)) == 19 and table.days() == ["2024-01-04"]
    assert table.prune(START + timedelta(hours=95, minutes=30)) == 24 and table.days() == []


def test_a_query_reads_the_days_it_asks_for(spark, table):
    table.replace_days(hourly(spark, 0, 72))
    plan = table.of_days(["2024-01-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan
