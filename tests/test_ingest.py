"""The ingest run end to end on small landing folders."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.config import RunConfig
from tidemark.plans import reports
from tidemark.sources import feed
from tidemark.sources.snapshots import SnapshotStore
from tidemark.streaming import ingest

CFG = RunConfig(datetime(2026, 9, 4, 12), max_files_per_trigger=1)


def record(key, created, updated, **more):
    base = {
        ":updated_at": int(datetime.fromisoformat(updated + "+00:00").timestamp()),
        "unique_key": key,
        "created_date": created,
        "complaint_type": "Rodent",
        "borough": "BROOKLYN",
        "incident_zip": "11238",
        "incident_address": "31 North 8th Street",
        "latitude": "40.6811",
        "longitude": "-73.9612",
    }
    return {k: v for k, v in (base | more).items() if v is not None}


# Two pages. The second revises records of the first.
PAGE_1 = [
    record("100", "2026-09-03T10:00:00", "2026-09-03T10:05:00"),
    record("101", "2026-09-03T10:50:00", "2026-09-03T10:55:00", incident_address="31 N. 8 ST"),
    record("102", "2026-09-03T11:45:00", "2026-09-03T11:46:00"),
    record("103", "2026-09-03T23:50:00", "2026-09-03T23:55:00", complaint_type="Heating", incident_zip="N/A"),
    record("104", "2026-09-03T08:30:00", "2026-09-03T10:00:00", incident_zip=None),
    record(None, "2026-09-03T09:00:00", "2026-09-03T10:00:00"),
    record(" ", "2026-09-03T09:00:00", "2026-09-03T10:00:00"),
    record("105", None, "2026-09-03T10:00:00"),
    record("106", "2026-09-02T10:00:00", "2026-09-03T10:00:00", borough="Bronx"),
    record("106", "2026-09-02T10:00:00", "2026-09-03T10:01:00", borough="Bronx", closed_date="2026-09-02T12:00:00"),
]
PAGE_2 = [
    # Leaves the group of 100 and 101, so 102 is on its own again.
    record("101", "2026-09-03T10:50:00", "2026-09-04T08:00:00", incident_address="99 Elm Road"),
    # Crosses midnight to join 103.
    record("107", "2026-09-04T00:05:00", "2026-09-04T08:01:00", complaint_type="heat/hot water"),
    # Moves to another day.
    record("104", "2026-09-01T09:00:00", "2026-09-04T08:02:00", incident_zip=None),
    # An older revision than the stored one.
    record("100", "2026-08-01T10:00:00", "2026-09-01T08:02:00"),
    # A later rejected revision does not remove the served record.
    record("102", None, "2026-09-04T08:03:00"),
]
SERVED = {
    ("100", "2026-09-03", None),
    ("101", "2026-09-03", None),
    ("102", "2026-09-03", None),
    ("103", "2026-09-03", None),
    ("104", "2026-09-01", None),
    ("106", "2026-09-02", None),
    ("107", "2026-09-04", "103"),
}


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def served(store):
    rows = store.read("clean").select("unique_key", F.to_date("created_date").cast("string"), "is_duplicate_of")
    return {tuple(r) for r in rows.collect()}


def tables(store):
    """Contents without the columns that tell the time or number of a run."""
    out = {}
    for name in ("clean", "raw", "failures", "quarantine", "daily"):
        df = store.read(name)
        skip = {"updated_at", "ingested_at", "detected_at", "computed_at", "ingest_run_id"}
        df = df.select(*[c for c in df.columns if c not in skip])
        out[name] = sorted(map(str, df.collect()))
    return out


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("ingest")
    land(base / "landing", "1.json", PAGE_1)
    store = SnapshotStore(spark, str(base / "store"))
    first = ingest.run_stream(store, str(base / "landing"), CFG)
    middle = served(store)
    land(base / "landing", "2.json", PAGE_2)
    second = ingest.run_stream(store, str(base / "landing"), CFG)
    return base, store, first, middle, second


def test_first_run(streamed):
    _, store, first, middle, _ = streamed
    assert {k: v for k, v, in first.items() if k.startswith("rows") or k == "status"} == {
        "status": "success",
        "rows_fetched": 10,
        "rows_inserted": 6,
        "rows_updated": 1,
        "rows_rejected": 3,
        "rows_flagged": 4,
    }
    assert ("101", "2026-09-03", "100") in middle and ("102", "2026-09-03", "100") in middle


def test_revisions_move_records_and_links(streamed):
    _, store, _, _, second = streamed
    assert served(store) == SERVED
    assert second["rows_inserted"] == 1 and second["rows_updated"] == 2
    assert second["links_new"] == 1 and second["rows_rejected"] == 1


def test_watermark_and_run_log(streamed):
    _, store, _, _, _ = streamed
    assert store.head()["watermark"].startswith("2026-09-04 08:03:00.001")
    runs = store.read("runs").orderBy("id").collect()
    assert [(r["id"], r["status"], r["rows_fetched"]) for r in runs] == [(1, "success", 10), (2, "success", 5)]
    deltas = reports.run_deltas(store.read("runs")).orderBy("id").collect()
    assert [r["rows_fetched_change"] for r in deltas] == [None, -5]


def test_side_tables(streamed):
    _, store, _, _, _ = streamed
    raw = {r["unique_key"]: r["seen_count"] for r in store.read("raw").collect()}
    assert raw == {"103": 1, "104": 2, " ": 1, "105": 1, "106": 2, "102": 1}
    assert store.read("quarantine").count() == 1
    failures = [(r["unique_key"], r["rule"]) for r in store.read("failures").collect()]
    assert failures.count(("104", "zip_missing")) == 2
    assert failures.count(("106", "borough_zip_conflict")) == 1


def test_daily_follows_the_served_table(spark, streamed):
    from tidemark.operators.rollup import rollup

    _, store, _, _, _ = streamed
    daily = store.read("daily").drop("part", "computed_at")
    fresh = rollup(store.read("clean"))
    assert daily.exceptAll(fresh).count() == 0 and fresh.exceptAll(daily).count() == 0


def test_a_committed_batch_is_not_applied_twice(spark, streamed):
    base, store, _, _, _ = streamed
    before, version = tables(store), store.head()["version"]
    again = feed.read_feed(spark, str(base / "landing" / "2.json"))
    assert ingest.apply_batch(store, again, CFG, 9, ("feed", 1)) is None
    assert store.head()["version"] == version and tables(store) == before


@pytest.mark.parametrize("walk_below", [0, 1_000])
def test_batch_equals_stream(spark, streamed, tmp_path, monkeypatch, walk_below):
    """Also where each batch walks its clusters, and where each reads its groups whole."""
    monkeypatch.setattr(ingest, "WALK_BELOW", walk_below)
    base, store, _, _, _ = streamed
    other = SnapshotStore(spark, str(tmp_path / "store"))
    for page in ("1.json", "2.json"):
        rows = feed.read_feed(spark, str(base / "landing" / page))
        ingest.run_batch(other, rows, CFG, reset_watermark=page == "2.json")
    # The batch scan starts at the watermark: the stale revision of 100 lies before it and is not
    # even read, where the stream reads and refuses it. The tables come out alike.
    assert tables(other) == tables(store)


def test_failed_batch_leaves_the_store_alone(spark, streamed, tmp_path):
    base, store, _, _, _ = streamed
    before = tables(store)
    broken = feed.read_feed(spark, str(base / "landing")).withColumn(
        "unique_key", F.raise_error(F.lit("disk full")).cast("string")
    )
    with pytest.raises(Exception, match="disk full"):
        ingest.run_batch(store, broken, CFG, reset_watermark=True)
    assert tables(store) == before
    last = reports.latest_run(store.read("runs").where("id > 2")).first()
    assert last["status"] == "failed" and "disk full" in last["error"]


def test_prune_freezes_the_daily_table(spark, streamed, tmp_path):
    base, _, _, _, _ = streamed
    store = SnapshotStore(spark, str(tmp_path / "store"))
    ingest.run_batch(store, feed.read_feed(spark, str(base / "landing" / "1.json")), CFG)
    daily = store.read("daily").drop("computed_at").collect()
    # 60 days on, inside the day of most records: those before 10:50 go.
    later = RunConfig(datetime(2026, 9, 3, 10, 50) + timedelta(days=60), start_days_back=90)
    pruned = ingest.prune(store, later)
    assert pruned["clean"] == 3 and pruned["raw"] == 5 and pruned["runs"] == 0
    assert {k for k, _, _ in served(store)} == {"101", "102", "103"}
    late = [record("200", "2026-09-03T08:00:00", "2026-11-01T00:00:00"), record("201", "2026-10-03T08:00:00", "2026-11-01T00:00:00")]
    land(tmp_path / "landing", "3.json", late)
    ingest.apply_batch(store, feed.read_feed(spark, str(tmp_path / "landing")), later, 2)
    after = store.read("daily").drop("computed_at")
    assert sorted(map(str, after.where("day < '2026-10-01'").collect())) == sorted(map(str, daily))
    assert after.where("day = '2026-10-03'").count() == 1
    # Rebuilding leaves the frozen days alone too.
    assert ingest.rebuild_days(store, later, 90) == ["2026-10-03"]
    assert store.read("daily").count() == len(daily) + 1
    # Unreferenced files go, the tables stay.
    kept = tables(store)
    assert store.vacuum() > 0 and tables(store) == kept and store.vacuum() == 0


def test_second_writer_is_refused(spark, streamed, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    head = store.head()
    store.commit(head, watermark="2026-01-01 00:00:00")
    with pytest.raises(Exception):
        store.commit(head, watermark="2026-01-02 00:00:00")
    assert ingest.reset_watermark(store, CFG, 5) == datetime(2026, 8, 30, 12)
    assert store.head()["watermark"].startswith("2026-08-30 12:00:00")


def test_unfinished_commit_does_not_block(spark, tmp_path):
    root = tmp_path / "store"
    left = root / "commits" / "version=000000001" / "_temporary" / "0"
    left.mkdir(parents=True)
    store = SnapshotStore(spark, str(root))
    assert store.head()["version"] == 0
    store.commit(store.head(), watermark="2026-01-01 00:00:00")
    left = root / "commits" / "version=000000002" / "_temporary" / "0"
    left.mkdir(parents=True)
    assert store.head()["version"] == 1
    assert store.commit(store.head(), watermark="2026-01-02 00:00:00")["version"] == 2
    assert store.head()["watermark"] == "2026-01-02 00:00:00"


def test_a_run_deletes_what_earlier_runs_left(spark, tmp_path):
    def size(table):
        return sum(f.stat().st_size for f in (root / table).rglob("*.parquet"))

    root = tmp_path / "store"
    store = SnapshotStore(spark, str(root))
    land(tmp_path / "landing", "1.json", PAGE_1)
    ingest.run_batch(store, feed.read_feed(spark, str(tmp_path / "landing")), CFG)
    before = size("clean")
    later = RunConfig(CFG.as_of + timedelta(days=90))
    assert ingest.prune(store, later)["clean"] == len(PAGE_1) - 4
    land(tmp_path / "empty", "1.json", [])
    ingest.run_batch(store, feed.read_feed(spark, str(tmp_path / "empty")), later)
    assert size("clean") < before and store.read("clean").count() == 0
    assert len(list((root / "staging").iterdir())) == 1


def test_pages_layout_and_profiles(spark, tmp_path):
    land(tmp_path / "lines", "a.json", PAGE_1)
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "a.json").write_text(json.dumps(PAGE_1[:6], indent=1))
    (pages / "b.json").write_text(json.dumps(PAGE_1[6:]))
    one, other = feed.read_feed(spark, str(tmp_path / "lines")), feed.read_feed(spark, str(pages), "pages")
    assert one.drop("payload").exceptAll(other.drop("payload")).count() == 0 and other.count() == 10
    profile = feed.feed_profile(one).first()
    assert profile["rows_returned"] == 10 and profile["has_updated_at"]
    assert json.loads(profile["sample"])["unique_key"] == "103"
    fields = {r["field"]: (r["rows_present"], r["rows_filled"]) for r in feed.field_profile(one).collect()}
    assert fields["unique_key"] == (9, 9) and fields["closed_date"] == (1, 1) and ":updated_at" in fields


def test_quality_report_and_storage(spark, streamed):
    _, store, _, _, _ = streamed
    stored = {n: store.read(n) for n in ("clean", "raw", "failures", "daily", "runs")}
    report = reports.quality_report(spark, stored, CFG.as_of_col + F.expr("INTERVAL 1 HOUR"))
    rules = {r["rule"]: (r["severity"], r["failures"]) for r in report["rules"].collect()}
    assert len(rules) == 16 and rules["unique_key_missing"][0] == "reject"
    assert report["totals"].first()["clean_rows"] == len(SERVED)
    assert report["settings"].first()["clean_days"] == 60
    sizes = reports.storage_report({n: stored[n] for n in ("clean", "daily")}, CFG.storage_budget_bytes)
    assert {r["table_name"]: r["row_count"] for r in sizes.collect()}["clean"] == len(SERVED)


def test_scans_read_days_of_arrival_and_resets_replay_them(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    arrived = ["2026-08-20", "2026-09-02", "2026-09-03", "2026-09-04"]
    for n, day in enumerate(arrived):
        rows = [record(str(n), f"{day}T01:00:00", f"{day}T02:00:00")]
        land(landing / f"arrived_on={day}", "1.json", rows)

    plan = feed.read_feed(spark, str(landing), arrived_from="2026-09-02")
    assert plan.count() == 3
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(arrived_on" in physical

    batch = SnapshotStore(spark, str(tmp_path / "batch"))
    assert ingest.run_landed(batch, str(landing), CFG)["rows_fetched"] == 3
    # The record at the watermark is older by a millisecond.
    assert ingest.run_landed(batch, str(landing), CFG)["rows_fetched"] == 0
    ingest.reset_watermark(batch, CFG, days_back=2)
    assert ingest.run_landed(batch, str(landing), CFG)["rows_fetched"] == 2

    stream = SnapshotStore(spark, str(tmp_path / "stream"))
    many = RunConfig(CFG.as_of)
    assert ingest.run_stream(stream, str(landing), many)["rows_fetched"] == 4
    assert ingest.run_stream(stream, str(landing), many)["rows_fetched"] == 0
    before = served(stream)
    ingest.reset_watermark(stream, CFG, days_back=1)
    again = ingest.run_stream(stream, str(landing), many)
    # The day before the watermark's is read too.
    assert again["rows_fetched"] == 3 and again["rows_inserted"] == 0
    assert served(stream) == before
    assert ingest.run_stream(stream, str(landing), many)["rows_fetched"] == 0


def test_a_day_lands_as_one_file_however_large(spark, tmp_path):
    """Micro-batches are counted in files, so a day that fell into many files made many batches."""
    from tidemark.plans.queries import _land
    from tidemark.sources.feed import ARRIVED

    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "64k")
    try:
        lines = spark.range(0, 60_000, numPartitions=4).select(
            F.sha2(F.col("id").cast("string"), 256).alias("value"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias(ARRIVED),
        )
        _land(lines, f"{tmp_path}/landing")
    finally:
        spark.conf.unset(size)
    assert sorted(len(list(d.glob("*.txt"))) for d in (tmp_path / "landing").glob(f"{ARRIVED}=*")) == [1, 1, 1]
    assert spark.read.text(f"{tmp_path}/landing").count() == 60_000
