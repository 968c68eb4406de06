"""One rule broken at a time, and the rules as a whole."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.config import timestamp_literal
from tidemark.operators import validate as V
from tidemark.operators.standardize import standardize
from tidemark.plans.reports import stored_rule_counts



def now():
    return timestamp_literal(datetime(2026, 9, 4, 12))


GOOD = {
    "unique_key": "1",
    "created_date": "2026-09-04T10:00:00",
    "closed_date": "2026-09-04T11:00:00",
    "complaint_type": "Rodent",
    "borough": "BROOKLYN",
    "incident_zip": "11238",
    "incident_address": "1 Main St",
    "latitude": "40.6811",
    "longitude": "-73.9612",
}
# change to a good record -> (failed rules, detail of the first, field value of the first)
CASES = [
    ({}, [], None, None),
    ({"unique_key": None}, ["unique_key_missing"], "unique_key is absent", None),
    ({"unique_key": "  "}, ["unique_key_missing"], "unique_key is absent", None),
    ({"complaint_type": "  "}, ["complaint_type_missing"], "complaint_type is absent", None),
    (
        {"complaint_type": "Zebra " * 30},
        ["complaint_type_unrecognized"],
        "complaint type is not in the known-category table; record kept",
        ("Zebra " * 30),
    ),
    ({"created_date": "soon"}, ["created_date_missing"], "created_date is absent", None),
    (
        {"closed_date": "2026-09-04T08:54:59"},
        ["closed_before_created"],
        "closed_date precedes created_date by 1:05:01",
        "2026-09-04T08:54:59+00:00",
    ),
    ({"closed_date": "2026-09-04T09:59:00"}, [], None, None),
    ({"closed_date": None}, [], None, None),
    ({"created_date": "2026-09-04T13:00:00", "closed_date": None}, [], None, None),
    (
        {"created_date": "2026-09-04T13:00:01", "closed_date": None},
        ["created_date_future"],
        "created_date is in the future",
        "2026-09-04T13:00:01+00:00",
    ),
    ({"incident_zip": None}, ["zip_missing"], "incident_zip is empty", None),
    ({"incident_zip": " "}, ["zip_missing"], "incident_zip is empty", None),
    (
        {"incident_zip": "N/A" * 40},
        ["zip_malformed"],
        "incident_zip is not a parseable five-digit ZIP",
        ("N/A" * 40),
    ),
    (
        {"incident_zip": "07030"},
        ["zip_outside_nyc"],
        "ZIP is well-formed but not allocated to New York City",
        "07030",
    ),
    (
        {"latitude": None, "longitude": "x"},
        ["coords_missing"],
        "latitude and longitude are both absent",
        None,
    ),
    (
        {"latitude": None},
        ["coords_partial"],
        "exactly one of latitude/longitude is present",
        "lat=None lon=-73.9612",
    ),
    (
        {"latitude": "0", "longitude": "0.0"},
        ["coords_null_island"],
        "coordinates are (0, 0) -- a null sentinel, not a location",
        "0,0",
    ),
    (
        {"latitude": "-73.9612", "longitude": "40.6811"},
        ["coords_swapped"],
        "latitude and longitude appear transposed",
        "-73.9612,40.6811",
    ),
    (
        {"latitude": "34.05", "longitude": "-118"},
        ["coords_outside_nyc"],
        "coordinates fall outside the New York City bounding box",
        "34.05,-118.0",
    ),
    (
        {"borough": "Bronx"},
        ["borough_zip_conflict"],
        "borough is BRONX but ZIP 11238 is allocated to BROOKLYN",
        "BRONX/11238",
    ),
    (
        {"incident_zip": "10463"},
        ["borough_zip_conflict"],
        "borough is BROOKLYN but ZIP 10463 is allocated to None",
        "BROOKLYN/10463",
    ),
    ({"borough": "Unspecified"}, [], None, None),
    (
        {"incident_zip": "N/A", "latitude": "0", "longitude": "0", "closed_date": "2026-09-01"},
        ["closed_before_created", "zip_malformed", "coords_null_island"],
        "closed_date precedes created_date by 3 days, 10:00:00",
        "2026-09-01T00:00:00+00:00",
    ),
]


@pytest.fixture(scope="module")
def checked(spark):
    rows = [{"i": str(i), **GOOD, **change} for i, (change, *_) in enumerate(CASES)]
    schema = ", ".join(f"{c} string" for c in ("i", *GOOD))
    feed = spark.createDataFrame([tuple(r[c] for c in ("i", *GOOD)) for r in rows], schema)
    return V.validate(standardize(feed, keep=("i",)), now()).cache()


def test_each_rule(checked):
    got = {int(r["i"]): r for r in checked.collect()}
    for i, (change, rules, detail, value) in enumerate(CASES):
        failures = got[i]["failures"]
        assert [f["rule"] for f in failures] == rules, change
        if rules:
            assert (failures[0]["detail"], failures[0]["field_value"]) == (detail, value)


def test_severity_decides_reject_and_defects(checked):
    severity = {name: s for name, s, _ in fixed.RULES}
    for r in checked.collect():
        assert all(f["severity"] == severity[f["rule"]] for f in r["failures"])
        kinds = [f["severity"] for f in r["failures"]]
        assert r["is_rejected"] == ("reject" in kinds)
        assert r["defect_count"] == len([k for k in kinds if k != "observe"])
        rules = {f["rule"] for f in r["failures"]}
        assert r["unrecognized_type"] == ("complaint_type_unrecognized" in rules)
        assert r["zip_borough_conflict"] == ("borough_zip_conflict" in rules)
    assert V.accepted(checked).count() + V.rejected(checked).count() == len(CASES)


def test_rule_counts_cover_the_registry(checked):
    exploded = {
        r["rule"]: r["count"] for r in V.failure_rows(checked).groupBy("rule").count().collect()
    }
    counted = {r["rule"]: r["failures"] for r in V.rule_counts(checked).collect()}
    assert set(counted) == {name for name, _, _ in fixed.RULES}
    assert {k: v for k, v in counted.items() if v} == exploded


def test_rule_counts_of_added_rules(spark):
    feed = spark.createDataFrame([tuple(GOOD.values())] * 3, ", ".join(f"{c} string" for c in GOOD))
    plain = V.Rule("address_plain", V.FLAG, "no number", F.lit(True))
    unused = V.Rule("address_odd", V.REJECT, "odd", F.lit(False))
    checks = {"address": [plain], "odd": [unused]}
    checked = V.validate(standardize(feed), now(), checks)
    added = {"address_plain": V.FLAG, "address_odd": V.REJECT}
    got = {r["rule"]: tuple(r)[1:] for r in V.rule_counts(checked, checks).collect()}
    n = len(fixed.RULES)
    assert got["address_plain"] == (V.FLAG, n, 3) and got["address_odd"] == (V.REJECT, n + 1, 0)
    assert set(got) == {name for name, _, _ in fixed.RULES} | set(added)
    stored = {r["rule"]: r for r in stored_rule_counts(V.failure_rows(checked)).collect()}
    assert stored["address_plain"]["failures"] == 3 and stored["address_plain"]["severity"] == V.FLAG
    assert stored["zip_missing"]["failures"] == 0


def test_lengths_are_an_option(spark):
    feed = spark.createDataFrame([("x" * 5000,)], "descriptor string")
    assert len(standardize(feed).first()["descriptor"]) == 5000
    assert len(standardize(feed, lengths={"descriptor": 7}).first()["descriptor"]) == 7


def test_zip_ranges_that_overlap(spark):
    from tidemark.operators.places import join_zip_borough

    zips = spark.createDataFrame([("00005",), ("00012",), ("00030",)], "z string")
    ranges = [(1, 10, "A"), (5, 20, "B")]
    got = {r["z"]: r["zip_borough"] for r in join_zip_borough(zips, "z", ranges).collect()}
    assert got == {"00005": "A", "00012": "B", "00030": None}
    with pytest.raises(ValueError):
        join_zip_borough(zips, "z", [(1, 100_000, "A")])


def test_without_a_clock_nothing_is_in_the_future(spark, checked):
    feed = spark.createDataFrame([("2999-01-01",)], "created_date string")
    rules = [f["rule"] for f in V.validate(standardize(feed)).first()["failures"]]
    assert "created_date_future" not in rules


def test_extra_checks(spark):
    feed = spark.createDataFrame([tuple(GOOD.values())], ", ".join(f"{c} string" for c in GOOD))
    short = V.Rule("address_short", V.REJECT, "only {n} characters", F.length("address_norm") < 20,
                   parts={"n": F.length("address_norm")})
    row = V.validate(standardize(feed), now(), {"address": [short]}).first()
    assert [(f["rule"], f["detail"]) for f in row["failures"]] == [("address_short", "only 9 characters")]
    assert row["is_rejected"] and row["defect_count"] == 1


def test_polygon_rule(spark):
    feed = spark.createDataFrame([tuple(GOOD.values())], ", ".join(f"{c} string" for c in GOOD))

    def failures(found, **change):
        records = standardize(feed).withColumn("found_borough", F.lit(found).cast("string"))
        records = records.withColumns({k: F.lit(v) for k, v in change.items()})
        return [tuple(f) for f in V.validate(records, now()).first()["failures"]]

    assert failures("QUEENS") == [
        (
            "borough_geo_conflict",
            "flag",
            "borough is BROOKLYN but the coordinates fall in QUEENS",
            "BROOKLYN/40.6811,-73.9612",
        )
    ]
    assert failures("BROOKLYN") == [] and failures(None) == []
    # A ZIP conflict is reported alone.
    assert [f[0] for f in failures("QUEENS", borough="BRONX")] == ["borough_zip_conflict"]


def test_malformed_rows_never_fail(spark):
    from tidemark.sources.feed import parse_payloads

    lines = ["{}", "[]", "not json", '{"unique_key": 5, "latitude": {"a": 1}}', '{"created_date": 17}', ""]
    rows = spark.createDataFrame([(v,) for v in lines], "value string")
    out = V.validate(standardize(parse_payloads(rows), keep=("payload",)), now())
    assert out.count() == len(lines)
    assert out.where("unique_key = '5'").count() == 1


def test_run_counters(checked):
    c = V.run_counters(checked).first()
    assert (c["rows_fetched"], c["rows_keyless"]) == (len(CASES), 1)
    assert c["rows_rejected"] == 4 and c["rows_accepted"] == len(CASES) - 4


def test_replay_tells_what_changed(spark):
    import json

    payloads = spark.createDataFrame(
        [("1", json.dumps(GOOD)), ("2", json.dumps({**GOOD, "unique_key": "2", "incident_zip": ""}))],
        "unique_key string, payload string",
    )
    stored = spark.createDataFrame(
        [("1", "zip_missing"), ("2", "coords_missing")], "unique_key string, rule string"
    )
    got = {tuple(r) for r in V.replay(payloads, stored, now()).collect()}
    assert got == {
        ("1", "zip_missing", "fixed"),
        ("2", "coords_missing", "fixed"),
        ("2", "zip_missing", "new"),
    }


def test_batch_is_checked_by_compiled_columns_straight_from_the_events(spark, tmp_path):
    """No landing table is written for the checked batch, and no column of it is an interpreted array function."""
    from tidemark.plans import derived

    sf_dir = str(tmp_path)
    rows = [(i, f"2024-01-0{i % 9 + 1} 10:00:00", i, "click", 1.5, '{"k": %d}' % i) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{sf_dir}/events.parquet")
    checked = derived.validated_now(spark, sf_dir)
    assert not [k for k in derived._written if k[1] == sf_dir]
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "address_norm" in plan and "lambdafunction" not in plan
    landed = V.validate(standardize(derived.landed(spark, sf_dir), keep=("event_id", "ts")), derived.as_of())
    assert sorted(map(str, checked.collect())) == sorted(map(str, landed.collect()))
    assert checked.schema.simpleString() == landed.schema.simpleString()
