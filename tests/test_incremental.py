"""Clusters walked from touched records against clusters of everything."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import duplicates, incremental

SCHEMA = "unique_key string, complaint_type_norm string, address_norm string, created_date timestamp"
START = datetime(2024, 3, 1)


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


class Stored:
    """Records by day, noting which days and how many rows are read."""

    def __init__(self, spark, rows):
        self.rows = spark.createDataFrame(rows, SCHEMA).withColumn(
            "part", F.date_format("created_date", "yyyy-MM-dd")
        ).cache()
        self.days, self.read = [], 0

    def __call__(self, days):
        part = self.rows.where(F.col("part").isin(days)).drop("part")
        self.days += days
        self.read += part.count()
        return part


def links(rows):
    return {r.unique_key: r.is_duplicate_of for r in rows.select("unique_key", "is_duplicate_of").collect()}


def touched(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).drop("unique_key")


@pytest.mark.parametrize("window", [60, 7])
def test_random_batches(spark, window):
    """Links before the batch, laid over with those of the walk, are those of everything afresh."""
    rng = random.Random(window)
    for _ in range(2):
        rows = {}
        for i in range(rng.randint(20, 150)):
            rows[str(i)] = (str(i), rng.choice("ab"), rng.choice(["x", "y", None]), at(rng.randrange(0, window * 60)))
        before = links(duplicates.mark_duplicates(spark.createDataFrame(list(rows.values()), SCHEMA), window))
        places = []
        for i in rng.sample(sorted(rows), 5):
            places.append(rows.pop(i))  # lost, as when a revision is moved
        for i in range(1000, 1000 + rng.randint(0, 6)):
            rows[str(i)] = (str(i), "a", rng.choice(["x", None]), rng.choice([None, at(rng.randrange(0, window * 60))]))
            places.append(rows[str(i)])
        stored = Stored(spark, list(rows.values()))
        got = {k: v for k, v in before.items() if k in rows} | dict.fromkeys(k for k in rows if int(k) >= 1000)
        got |= links(incremental.relink(stored, touched(spark, places), window))
        assert got == links(duplicates.mark_duplicates(stored.rows, window))


def test_gaps_and_long_chains(spark):
    chain = [(f"c{i:03}", "a", "x", at(60 * i)) for i in range(100)]
    rows = [*chain, ("lone", "a", "x", at(-61)), ("after", "a", "x", at(60 * 99 + 61)), ("other", "b", "x", at(0))]
    stored = Stored(spark, rows)
    got = links(incremental.relink(stored, touched(spark, [chain[70]]), 60))
    assert got == {"c000": None} | {f"c{i:03}": "c000" for i in range(1, 100)}
    # A record that is gone splits its chain; both halves are told.
    stored = Stored(spark, [r for r in rows if r[0] != "c070"])
    got = links(incremental.relink(stored, touched(spark, [chain[70]]), 60))
    assert got["c069"] == "c000" and got["c071"] is None and got["c099"] == "c071"
    # One that comes back joins them.
    got = links(incremental.relink(Stored(spark, rows), touched(spark, [chain[70]]), 60))
    assert got["c099"] == "c000"


def test_nothing_touched(spark):
    stored = Stored(spark, [("1", "a", "x", at(0)), ("2", "a", "x", at(1))])
    for places in ([], [("3", None, "x", at(0))], [("3", "a", "x", None)], [("3", "a", "", at(0))]):
        assert incremental.relink(stored, touched(spark, places), 60).count() == 0
    assert stored.read == 0


def test_rows_read_do_not_grow_with_the_group(spark):
    """One address with records on every day: a batch on one day reads the days about it."""
    reads = []
    for days in (10, 40):
        rows = [(f"{d}-{i}", "a", "x", at(1440 * d + 10 * i)) for d in range(days) for i in range(20)]
        new = ("new", "a", "x", at(1440 * 5 + 205))
        stored = Stored(spark, [*rows, new])
        got = links(incremental.relink(stored, touched(spark, [new]), 60))
        assert got["new"] == "5-0" and len(got) == 21
        assert set(stored.days) <= {"2024-03-05", "2024-03-06", "2024-03-07"}
        reads.append(stored.read)
    assert reads[0] == reads[1]


def test_touched_rows_are_computed_once(spark):
    """However many rounds the walk has, what the batch touched is worked out in one of them."""
    rows = [(f"{n:03}", "noise", "1 A ST", at(50 * n)) for n in range(8)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(group):
        seen.add(1)
        return True

    places = spark.createDataFrame([r[1:] for r in rows[3:5]], "complaint_type_norm string, address_norm string, created_date timestamp")
    got = incremental.relink(Stored(spark, rows), places.where(counted("address_norm")), 60)
    whole = links(duplicates.mark_duplicates(spark.createDataFrame(rows, SCHEMA), 60))
    assert links(got) == whole and len(whole) == 8
    assert seen.value == 2
