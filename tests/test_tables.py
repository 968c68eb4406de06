"""Rollup, median, upsert, places, retention and the read queries."""

import json
import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.config import timestamp_literal
from tidemark.operators import places, retention, rollup, upsert
from tidemark.operators.median import exact_median
from tidemark.plans import reports
from tidemark.sources.boundaries import build_boundaries, load_boundaries, read_boundaries

CLEAN = (
    "unique_key string, created_date timestamp, closed_date timestamp, status string, borough string, "
    "complaint_type_norm string, defect_count int, is_duplicate_of string, unrecognized_type boolean, "
    "zip_borough_conflict boolean"
)


def clean(spark, rows):
    """rows: dicts over a default record; times as text."""
    base = {
        "unique_key": "1",
        "created_date": "2026-09-01 10:00:00",
        "closed_date": None,
        "status": "Open",
        "borough": "BRONX",
        "complaint_type_norm": "RODENT",
        "defect_count": 0,
        "is_duplicate_of": None,
        "unrecognized_type": False,
        "zip_borough_conflict": False,
    }
    data = [tuple((base | r).values()) for r in rows]
    text = CLEAN.replace("timestamp", "string")
    df = spark.createDataFrame(data, text)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("created_date", "closed_date")})


@pytest.mark.parametrize("width", [1, 10, 60_000_000])
def test_exact_median(spark, width):
    rnd = random.Random(width)
    values = {
        "even": [rnd.randint(0, 500) for _ in range(200)],
        "odd": [rnd.randint(0, 10**12) for _ in range(101)],
        "same": [7] * 50,
        "one": [3],
        "pair": [1, 10**9],
        "none": [None],
    }
    rows = [(g, v) for g, vs in values.items() for v in vs]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v bigint").repartition(5)
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v", width).collect()}
    assert got == {g: statistics.median(vs) for g, vs in values.items() if g != "none"}


def test_rollup_counts(spark):
    rows = [
        {"unique_key": "1", "closed_date": "2026-09-01 12:00:00"},
        {"unique_key": "2", "closed_date": "2026-09-01 11:00:00", "defect_count": 2},
        {"unique_key": "3", "closed_date": "2026-09-01 09:59:30"},
        {"unique_key": "4", "is_duplicate_of": "1", "defect_count": 1},
        {"unique_key": "5", "borough": None, "complaint_type_norm": None},
    ]
    got = {tuple(r) for r in rollup.rollup(clean(spark, rows)).collect()}
    day = datetime(2026, 9, 1).date()
    assert got == {
        (day, "BRONX", "RODENT", 3, 3, 1.5, 1, 1),
        (day, "UNSPECIFIED", "UNKNOWN", 1, 0, None, 0, 0),
    }


def test_replacing_days_drops_vanished_groups(spark):
    before = clean(spark, [{"unique_key": "1"}, {"unique_key": "2", "borough": "QUEENS"},
                           {"unique_key": "3", "created_date": "2026-08-30 01:00:00"}])
    after = clean(spark, [{"unique_key": "1"}, {"unique_key": "2"},
                          {"unique_key": "3", "created_date": "2026-08-30 01:00:00"}])
    days = rollup.days_of_keys(after, after.where("unique_key = '2'"))
    daily = rollup.replace_days(rollup.rollup(before), rollup.rollup_days(after, days), days)
    same = rollup.rollup(after)
    assert daily.exceptAll(same).count() == 0 and same.exceptAll(daily).count() == 0
    recent = rollup.days_since(after, timestamp_literal(datetime(2026, 9, 2)), 2)
    assert [str(r[0]) for r in recent.collect()] == ["2026-09-01"]


def test_latest_revision_limits_before_the_shuffle(spark):
    rows = [("hot", i) for i in range(200)] + [("cold", 5), ("cold", None)]
    df = spark.createDataFrame(rows, "k string, at int").repartition(4)
    out = upsert.latest_revision(df, ["k"], [F.desc_nulls_last("at")])
    assert {tuple(r) for r in out.collect()} == {("hot", 199), ("cold", 5)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_upsert_classifies_and_refuses_stale_rows(spark):
    stored = spark.createDataFrame([("a", 5, "old"), ("b", 5, "old"), ("c", 5, "old")], "k string, at int, v string")
    incoming = spark.createDataFrame([("a", 6, "new"), ("b", 4, "new"), ("d", 1, "new")], "k string, at int, v string")
    got = {(r["k"], r["v"], r["change"]) for r in upsert.upsert(stored, incoming, "k", "at").collect()}
    assert got == {("a", "new", "update"), ("b", "old", "kept"), ("c", "old", "kept"), ("d", "new", "insert")}


def test_flagged_payloads_count_every_sighting(spark):
    rows = [("a", 1, "p1", True), ("a", 2, "p2", False), ("b", 1, "q", False), (None, 1, "r", True)]
    df = spark.createDataFrame(rows, "unique_key string, s int, p string, bad boolean").select(
        "unique_key", F.timestamp_seconds("s").alias("source_updated_at"),
        F.lit(None).cast("timestamp").alias("created_date"), "p", "bad")
    first = upsert.flagged_payloads(df, F.col("p"), F.col("bad"))
    assert [(r["unique_key"], r["payload"], r["seen_count"]) for r in first.collect()] == [("a", "p2", 2)]
    again = upsert.merge_payloads(first, first)
    assert [r["seen_count"] for r in again.collect()] == [4]


def square(name, x, y, size, ring_only=True):
    ring = [[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]
    return ring


def winds_around(lat, lon, ring):
    """Whether the ring turns round the point: the angles to its corners add up to a full turn."""
    angles = [math.atan2(y - lat, x - lon) for x, y in ring]
    turns = (b - a for a, b in zip(angles, [*angles[1:], angles[0]]))
    return abs(sum((t + math.pi) % (2 * math.pi) - math.pi for t in turns)) > math.pi


def test_boundaries_and_points(spark, tmp_path):
    rnd = random.Random(4)

    def blob(cx, cy):
        return [
            [cx + rnd.uniform(0.02, 0.08) * math.cos(a / 20 * 2 * math.pi),
             cy + rnd.uniform(0.02, 0.08) * math.sin(a / 20 * 2 * math.pi)]
            for a in range(20)
        ]

    rings = {n: [blob(-73.9 + 0.03 * i, 40.7), blob(-73.9, 40.6 + 0.05 * i)] for i, n in enumerate(
        ["Manhattan", "Bronx", "Brooklyn", "Queens", "Staten Island"])}
    features = [
        {"type": "Feature", "properties": {"boro_name" if i % 2 else "BoroName": n},
         "geometry": {"type": "MultiPolygon", "coordinates": [[r] for r in rs]}}
        for i, (n, rs) in enumerate(rings.items())
    ]
    features.append({"type": "Feature", "properties": {"boro_name": "Nassau"},
                     "geometry": {"type": "Polygon", "coordinates": [square("x", 0, 0, 1)]}})
    features.append({"type": "Feature", "properties": {"boro_name": "manhattan"},
                     "geometry": {"type": "Polygon", "coordinates": [square("x", -74.1, 40.7, 0.05), [[0, 0]]]}})
    path = tmp_path / "b.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    polygons = read_boundaries(spark, str(path))
    assert polygons.count() == 11
    stored = str(tmp_path / "polygons")
    polygons.write.parquet(stored)

    rings["Manhattan"].append(square("x", -74.1, 40.7, 0.05))
    points = [(40.5 + rnd.random() * 0.4, -74.1 + rnd.random() * 0.4) for _ in range(1500)]
    points += [(None, -73.9), (float("nan"), -73.9), (40.72, -74.08)]
    df = spark.createDataFrame(points, "latitude double, longitude double")
    got = places.locate_points(df, load_boundaries(spark, stored)).collect()
    assert len(got) == len(points)
    for r in got:
        lat, lon = r["latitude"], r["longitude"]
        want = None
        if lat is not None and lat == lat:
            want = next((n.upper() for n, rs in rings.items() if any(winds_around(lat, lon, x) for x in rs)), None)
        assert r["found_borough"] == want
    assert sum(r["found_borough"] is not None for r in got) > 100

    path.write_text(json.dumps({"type": "FeatureCollection", "features": features[:4]}))
    with pytest.raises(ValueError):
        read_boundaries(spark, str(path))


def test_built_boundaries_are_checked_before_they_are_stored(spark, tmp_path):
    def feature(name, x):
        return {"type": "Feature", "properties": {"boro_name": name},
                "geometry": {"type": "Polygon", "coordinates": [square("x", x, 0.0, 1)]}}

    path, stored = tmp_path / "areas.geojson", str(tmp_path / "stored")
    path.write_text(json.dumps({"features": [feature("north", 0.0), feature("South", 2.0), feature("other", 4.0)]}, indent=2))
    built = build_boundaries(spark, str(path), stored, ["NORTH", "SOUTH"])
    assert sorted(r.borough for r in built.collect()) == ["NORTH", "SOUTH"]
    path.write_text(json.dumps({"features": [feature("north", 0.0)]}))
    with pytest.raises(ValueError):
        build_boundaries(spark, str(path), stored, ["NORTH", "SOUTH"])
    assert load_boundaries(spark, stored).count() == 2


def test_no_polygons_means_not_checked(spark):
    df = spark.createDataFrame([(40.7, -73.9)], "latitude double, longitude double")
    assert places.locate_points(df, load_boundaries(spark, None)).first()["found_borough"] is None


def test_retention_keeps_undated_rows(spark):
    df = clean(spark, [{"created_date": "2026-07-01 00:00:00"}, {"created_date": "2026-07-08 00:00:00"}, {"created_date": None}])
    now = timestamp_literal(datetime(2026, 9, 6))
    assert retention.prune(df, "created_date", now, 60).count() == 2
    counts = retention.prune_counts(df, "created_date", now, {"clean": 60}).first()
    assert tuple(counts) == ("clean", 2, 1)


def test_requests_page(spark):
    rows = [
        {"unique_key": str(i), "created_date": f"2026-09-0{1 + i % 3} 00:00:00", "status": "Closed" if i % 2 else "open"}
        for i in range(8)
    ] + [{"unique_key": "u", "created_date": None}, {"unique_key": "d", "is_duplicate_of": "1", "status": "CLOSED"}]
    df = clean(spark, rows)

    def keys(limit=200, offset=0, **f):
        return [r["unique_key"] for r in reports.requests_page(df, reports.request_filter(**f), limit, offset).collect()]

    assert keys() == ["2", "5", "1", "4", "7", "0", "3", "6", "u"]
    assert keys(3, 2) == ["1", "4", "7"]
    assert keys(status="CLO%") == ["5", "1", "7", "3"]
    assert "d" in keys(status="closed", include_duplicates=True)
    assert keys(borough="queens") == []
    assert keys(since="2026-09-03") == ["2", "5"]
    assert reports.requests_total(df, reports.request_filter()).first()[0] == 9
    with pytest.raises(ValueError):
        reports.requests_page(df, F.lit(True), 0)
    with pytest.raises(ValueError):
        reports.requests_page(df, F.lit(True), 1001)


def test_request_detail_and_labels(spark):
    df = clean(spark, [
        {"unique_key": "1", "defect_count": 1},
        {"unique_key": "2", "is_duplicate_of": "1", "defect_count": 3},
        {"unique_key": "3", "defect_count": 2},
        {"unique_key": "4", "unrecognized_type": True, "zip_borough_conflict": True, "defect_count": 1},
        {"unique_key": "5"},
    ])
    failures = spark.createDataFrame(
        [("1", "a", 1), ("1", "b", 2), ("9", "c", 3)], "unique_key string, rule string, s int"
    ).select("unique_key", "rule", F.lit("flag").alias("severity"), F.lit("").alias("detail"),
             F.lit("").alias("field_value"), F.timestamp_seconds("s").alias("detected_at"))
    detail = reports.request_detail(df, failures, "1")
    assert detail["request"].count() == 1
    assert [r["rule"] for r in detail["validation_failures"].collect()] == ["b", "a"]
    assert [r["unique_key"] for r in detail["collapsed_duplicates"].collect()] == ["2"]
    labels = [r[0] for r in df.orderBy("unique_key").select(reports.quality_labels()).collect()]
    assert labels == [["1 defect"], ["duplicate"], ["2 defects"], ["borough conflict", "new category"], []]


def test_health_states(spark):
    now = timestamp_literal(datetime(2026, 9, 2))

    def state(*runs):
        data = [(i, f"2026-09-01 {h:02d}:00:00", s, 10, 5, 1) for i, (h, s) in enumerate(runs)]
        df = spark.createDataFrame(data, "id bigint, t string, status string, rows_fetched bigint, "
                                   "rows_flagged bigint, duplicates_collapsed bigint")
        zero = F.lit(0).cast("bigint")
        df = df.withColumns({"started_at": F.col("t").cast("timestamp"), "finished_at": F.col("t").cast("timestamp"),
                             "rows_inserted": zero, "rows_updated": zero, "rows_rejected": zero})
        return reports.health(df, now).first()

    assert state((23, "success"))["state"] == "good"
    assert state((20, "success"))["state"] == "warning"
    assert state((21, "success"))["state"] == "good"
    assert state((22, "success"), (23, "partial"))["state"] == "critical"
    row = state((23, "success"), (23, "running"))
    assert (row["rows_fetched"], row["flag_rate_pct"], row["last_status"]) == (10, 50.0, "success")


def test_upsert_joins_once(spark):
    """Stored and incoming rows meet in one join; rows without a key or time and columns of one side stay whole."""
    stored = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, None, "c"), (None, 1, "d")], "k int, at int, s string")
    incoming = spark.createDataFrame([(1, 4, 9), (2, 5, 8), (3, 1, 7), (4, None, 6), (None, 2, 5)], "k int, at int, n int")
    merged = upsert.upsert(stored, incoming, "k", "at")
    assert merged.columns == ["k", "at", "s", "change", "n"]
    assert {tuple(r) for r in merged.collect()} == {
        (1, 5, "a", "kept", None), (2, 5, None, "update", 8), (3, 1, None, "update", 7),
        (4, None, None, "insert", 6), (None, 1, "d", "kept", None), (None, 2, None, "insert", 5),
    }
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
