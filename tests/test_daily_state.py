"""The daily state against the rollup of all records, and counters taken in passing."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import daily_state, rollup, validate
from tidemark.operators.standardize import standardize
from tidemark.schema import FEED_SCHEMA

SCHEMA = (
    "unique_key string, created_date timestamp, closed_date timestamp, borough string, "
    "complaint_type_norm string, defect_count int, is_duplicate_of string"
)


def record(rng: random.Random, key: int) -> tuple:
    created = rng.choice([None, *[datetime(2024, 1, d, rng.randrange(24)) for d in (1, 1, 2, 3)]])
    hours = rng.choice([None, -1, 0, 1, 1, 2, 30])
    closed = created + timedelta(hours=hours) if created and hours is not None else None
    kinds = rng.choice(["QUEENS", None]), rng.choice(["NOISE", "HEAT", None])
    return str(key), created, closed, *kinds, rng.randrange(3), rng.choice([None, None, "1"])


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches_of_differences(spark):
    rng = random.Random(7)
    records: dict[str, tuple] = {}
    states = [daily_state.state(spark.createDataFrame([], SCHEMA))]
    for _ in range(4):
        keys = rng.sample(sorted(records), min(len(records), 15))
        before = [records.pop(k) for k in keys]
        after = [record(rng, int(k)) for k in keys[5:]] + [record(rng, len(records) + 1000 * len(states) + i) for i in range(20)]
        records |= {r[0]: r for r in after}
        was, now = (spark.createDataFrame(r, SCHEMA) for r in (before, after))
        states.append(daily_state.difference(was, now))
        whole = spark.createDataFrame(list(records.values()), SCHEMA)
        assert told(daily_state.daily(*states)) == told(rollup.rollup(whole))
        assert told(daily_state.added(*states)) == told(daily_state.state(whole))
    gone = daily_state.difference(whole, spark.createDataFrame([], SCHEMA))
    assert daily_state.added(*states, gone).count() == 0 == daily_state.daily(*states, gone).count()


def test_a_touched_day_is_all_that_is_read(spark, tmp_path):
    """The figures of a day come from the state's files of that day."""
    rng = random.Random(1)
    rows = spark.createDataFrame([record(rng, i) for i in range(300)], SCHEMA)
    daily_state.state(rows).write.partitionBy("day").parquet(f"{tmp_path}/state")
    state = spark.read.parquet(f"{tmp_path}/state").select(*daily_state.COLUMNS)
    day = daily_state.daily(state.where("day = DATE '2024-01-02'"))
    assert told(day) == told(rollup.rollup(rows).where("day = DATE '2024-01-02'"))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-02" in plan


@pytest.mark.parametrize("rows", [0, 1, 400])
def test_counters_in_passing(spark, rows):
    rng = random.Random(rows)
    fields = [f.name for f in FEED_SCHEMA.fields]

    def value(name: str, i: int):
        if name == "unique_key":
            return str(i) if rng.random() < 0.9 else None
        if name == "complaint_type":
            return rng.choice(["Heating", "Strange", None])
        if name in ("created_date", "updated_at", ":updated_at"):
            return rng.choice(["2024-01-01T00:00:00.000", "2030-01-01T00:00:00.000", None])
        return None

    feed = spark.createDataFrame([tuple(value(n, i) for n in fields) for i in range(rows)], FEED_SCHEMA)
    checked = validate.validate(standardize(feed), F.lit("2024-02-01").cast("timestamp"))
    passing, told_counts = validate.observed(checked)

    def jobs(name: str, df) -> int:
        spark.sparkContext.setJobGroup(f"{name}-{rows}", "")
        df.write.format("noop").mode("overwrite").save()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{name}-{rows}"))

    assert jobs("plain", checked) == jobs("passing", passing)
    got = told_counts()
    want = validate.run_counters(checked).withColumn("max_updated_at", F.unix_micros("max_updated_at")).first().asDict()
    at = got.pop("max_updated_at")
    newest = want.pop("max_updated_at")
    assert got == want and got["rows_fetched"] == rows
    assert (int(at.timestamp() * 1_000_000) if at else None) == newest
