"""Duplicate linking against a plain loop over each group."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import duplicates as D

T0 = datetime(2026, 9, 2, 10)
SCHEMA = "unique_key string, complaint_type_norm string, address_norm string, created_date timestamp"


def records(n, seed, span_minutes=3000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # A third of all records sit in one group, many of them in one burst.
        hot = rnd.random() < 0.34
        kind = "NOISE" if hot else rnd.choice(["HEAT", "RODENT", None, ""])
        address = "1 MAIN ST" if hot else rnd.choice(["1 MAIN ST", "2 ELM RD", None])
        minute = rnd.choice([rnd.uniform(0, 30), rnd.uniform(0, span_minutes)])
        when = None if rnd.random() < 0.02 else T0 + timedelta(seconds=round(minute * 60))
        key = None if rnd.random() < 0.02 else str(i)
        rows.append((key, kind, address, when))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(k, c, a, t and t.strftime("%Y-%m-%d %H:%M:%S")) for k, c, a, t in rows],
        "unique_key string, complaint_type_norm string, address_norm string, t string",
    ).select("unique_key", "complaint_type_norm", "address_norm", F.col("t").cast("timestamp").alias("created_date"))


def brute_force(rows, minutes):
    groups = {}
    for key, kind, address, when in rows:
        if key and kind and address and when:
            groups.setdefault((kind, address), []).append((when, key))
    links = set()
    for members in groups.values():
        members.sort()
        head = last = members[0]
        for m in members[1:]:
            if m[0] - last[0] > timedelta(minutes=minutes):
                head = m
            else:
                links.add((m[1], head[1], round((m[0] - head[0]).total_seconds() / 60, 2)))
            last = m
    return links


@pytest.mark.parametrize("minutes", [0, 1, 7, 60, 1440])
def test_links_equal_the_plain_loop(spark, minutes):
    rows = records(600, seed=minutes)
    got = D.link_duplicates(frame(spark, rows), minutes).collect()
    want = {(k, h): m for k, h, m in brute_force(rows, minutes)}
    assert {(r["unique_key"], r["duplicate_of"]) for r in got} == set(want)
    assert all(abs(r["minutes_apart"] - want[r["unique_key"], r["duplicate_of"]]) < 0.011 for r in got)


def test_order_and_partitions_do_not_matter(spark):
    rows = records(300, seed=5)
    one = D.link_duplicates(frame(spark, rows).coalesce(1), 30)
    random.Random(1).shuffle(rows)
    other = D.link_duplicates(frame(spark, rows).repartition(7), 30)
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


def test_every_record_is_kept_once(spark):
    rows = records(400, seed=9)
    marked = D.mark_duplicates(frame(spark, rows), 60)
    assert marked.count() == len(rows)
    assert marked.where("is_duplicate_of IS NOT NULL").count() == len(brute_force(rows, 60))


def test_ties_go_to_the_smaller_key_as_text(spark):
    rows = [("9", "X", "A", T0), ("10", "X", "A", T0)]
    assert [tuple(r) for r in D.link_duplicates(frame(spark, rows), 60).collect()] == [("9", "10", 0.0)]


def test_wider_windows_never_link_less(spark):
    rows = records(500, seed=3)
    windows = [1, 5, 60, 240, 1440]
    swept = {r["window_minutes"]: r for r in D.sweep_windows(frame(spark, rows), windows).collect()}
    collapsed = [swept[w]["collapsed"] for w in windows]
    assert collapsed == sorted(collapsed)
    for w in windows:
        links = brute_force(rows, w)
        sizes = {}
        for _, head, _ in links:
            sizes[head] = sizes.get(head, 1) + 1
        assert swept[w]["collapsed"] == len(links)
        assert swept[w]["largest_cluster"] == max(sizes.values(), default=0)
        grown = {r[0]: r[1] + 1 for r in D.cluster_sizes(D.link_duplicates(frame(spark, rows), w)).collect()}
        assert grown == sizes


def test_sweep_without_candidates(spark):
    got = D.sweep_windows(frame(spark, [("1", None, "A", T0)]), [5, 60]).orderBy("window_minutes").collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0.0, 0), (60, 0, 0, 0.0, 0)]


@pytest.mark.parametrize("minutes", [0, 3, 45])
def test_neighbours_equal_the_pairwise_test(spark, minutes):
    rows = [r for r in records(400, seed=20 + minutes) if r[0]]
    touched = rows[::9]
    band = timedelta(minutes=2 * minutes)
    want = {
        k
        for k, c, a, t in rows
        if t
        and any(
            c is not None and a is not None and (c, a) == (tc, ta) and tt and abs(t - tt) <= band
            for _, tc, ta, tt in touched
        )
    }
    got = [r["unique_key"] for r in D.neighbours(frame(spark, rows), frame(spark, touched), minutes).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_applying_links_clears_old_ones(spark):
    rows = spark.createDataFrame([("a", "z"), ("b", "z"), ("c", None)], "unique_key string, is_duplicate_of string")
    links = spark.createDataFrame([("b", "a", 1.0)], "unique_key string, duplicate_of string, minutes_apart double")
    got = {tuple(r) for r in D.apply_links(rows, links).select("unique_key", "is_duplicate_of").collect()}
    assert got == {("a", None), ("b", "a"), ("c", None)}
