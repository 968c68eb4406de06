"""The ingest run: prune, then per batch standardize, validate, upsert, link, roll up, commit.

Batch and stream call the same :func:`apply_batch`. A batch lands as one commit or not at all,
and one that was committed before is skipped, so replays after a failure are harmless.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import RunConfig, timestamp_literal
from tidemark.operators import duplicates, incremental, places, retention, rollup, upsert, validate
from tidemark.operators.standardize import standardize, update_time
from tidemark.schema import CLEAN_FIELDS, RUN_COUNTERS
from tidemark.sources.feed import first_arrival, read_feed, stream_feed
from tidemark.sources.snapshots import SnapshotStore, appended, replaced

_GROUP = list(duplicates.GROUP)

#: A batch that touches fewer than one in so many days has its clusters walked outward. One that touches
#: more, as a first load does, would walk through everything, so its groups are read whole, once.
WALK_BELOW = 3


def _day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _list(days: DataFrame) -> list[str]:
    """Distinct days to the driver: as many as the calendar has, whatever the data size."""
    return [r[0] for r in days.distinct().collect() if r[0] is not None]


def apply_batch(
    store: SnapshotStore,
    feed: DataFrame,
    cfg: RunConfig,
    run_id: int,
    batch: tuple[str, int] | None = None,
    polygons: DataFrame | None = None,
) -> dict | None:
    """Applies one batch of feed records (with ``payload``) and commits it.

    ``batch`` is (stream name, number). Returns the counters, None when already applied.
    """
    head = store.head()
    if batch and head["batches"].get(batch[0], -1) >= batch[1]:
        return None
    now = cfg.as_of_col

    # The checked batch is written once, counted as it is written, and feeds every table.
    records = standardize(feed, keep=("payload",))
    if polygons is not None:
        records = places.locate_points(records, polygons)
    rows, told = validate.observed(validate.validate(records, now))
    checked = store.stage("checked", head, rows)
    counts = told()
    keyed = checked.where(F.col("unique_key").isNotNull())
    newest = [F.desc_nulls_last("source_updated_at"), F.xxhash64("payload")]

    # Upsert: only newer revisions get in.
    stored = store.read("clean", head)
    incoming = upsert.latest_revision(validate.accepted(keyed), ["unique_key"], newest)
    changes = store.stage(
        "changes",
        head,
        upsert.classify_changes(
            stored, incoming.select(*CLEAN_FIELDS), "unique_key", "source_updated_at"
        ).withColumns({"updated_at": now, "part": _day("created_date")}),
    )
    applied = changes.where("change <> 'stale'")
    by_change = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    keys = applied.select("unique_key")
    narrow = ["unique_key", *_GROUP, "created_date", "part"]
    before = store.stage("before", head, stored.join(keys, "unique_key", "left_semi").select(*narrow))

    # Links: of clusters about where a record was or is now.
    def as_they_are_now(days: list[str]) -> DataFrame:
        kept = store.read("clean", head, days).join(keys, "unique_key", "left_anti")
        return kept.select(*narrow, F.col("is_duplicate_of").alias("was")).unionByName(
            applied.where(F.col("part").isin(days)).select(*narrow), allowMissingColumns=True
        )

    touched = applied.select(*narrow).unionByName(before).select(*_GROUP, "created_date", "part")
    days = _list(touched.select("part"))
    every_day = sorted({*store.days(head, "clean"), *days})
    if len(days) * WALK_BELOW < len(every_day):
        linked = incremental.relink(as_they_are_now, touched, cfg.dedup_window_minutes)
    else:
        groups = duplicates.touched_groups(touched)
        members = as_they_are_now(every_day).join(groups, _GROUP, "left_semi")
        linked = duplicates.mark_duplicates(members, cfg.dedup_window_minutes)
    marked = store.stage(
        "marked", head, linked.select("unique_key", "part", "was", F.col("is_duplicate_of").alias("now"))
    )
    moved = ~F.col("now").eqNullSafe(F.col("was"))
    links = marked.agg(
        F.count_if(F.col("now").isNotNull()).alias("total"),
        F.count_if(F.col("now").isNotNull() & moved).alias("new"),
    ).first()

    # Rewrite the days a record entered, left or was relinked on.
    old_days = _list(
        before.select("part").union(applied.select("part")).union(marked.where(moved).select("part"))
    )
    today = _day(now)
    stamped = {"ingest_run_id": F.lit(run_id).cast("bigint"), "part": today}

    def write_served() -> dict:
        rows = (
            store.read("clean", head, old_days)
            .join(keys, "unique_key", "left_anti")
            .unionByName(applied.drop("change"), allowMissingColumns=True)
            .join(
                marked.select("unique_key", "now", F.lit(True).alias("clustered")),
                "unique_key",
                "left",
            )
        )
        # A revision that left every group has no link any more.
        renewed = F.when(F.col("clustered"), F.col("now")).otherwise(F.col("is_duplicate_of"))
        written = store.write_days("clean", head, rows.withColumn("is_duplicate_of", renewed))
        clean = replaced(head, "clean", old_days, written)
        # The rewritten days are whole, so the rollup reads them and nothing else. Days that lost
        # rows to retention keep the figures they had.
        open_days = [d for d in old_days if d not in head["frozen_days"]]
        after = {**head, "tables": {**head["tables"], "clean": clean}}
        fresh_days = rollup.rollup(store.read("clean", after, open_days)).withColumns(
            {"computed_at": now, "part": _day("day")}
        )
        daily = replaced(head, "daily", open_days, store.write_days("daily", head, fresh_days))
        return {"clean": clean, "daily": daily}

    def write_payloads() -> dict:
        raw = store.read("raw", head)
        flagged = store.stage(
            "flagged",
            head,
            upsert.flagged_payloads(keyed, F.col("payload"), validate.any_failure(keyed)),
        )
        found = flagged.select("unique_key")
        raw_days = _list(
            raw.join(found, "unique_key", "left_semi").select("part").union(flagged.select(today))
        )
        kept = store.read("raw", head, raw_days).join(found, "unique_key", "left_anti")
        fresh = upsert.merge_payloads(raw, flagged).withColumns(stamped | {"ingested_at": now})
        written = store.write_days("raw", head, kept.unionByName(fresh))
        return {"raw": replaced(head, "raw", raw_days, written)}

    def write_failures() -> dict:
        failing = keyed.where(validate.any_failure(keyed))
        rows = validate.failure_rows(
            upsert.latest_revision(failing, ["unique_key"], newest), "unique_key"
        ).withColumns(stamped | {"detected_at": now})
        return {"failures": appended(head, "failures", store.write_days("failures", head, rows))}

    def write_quarantine() -> dict:
        if not counts["rows_keyless"]:
            return {}
        rows = checked.where(F.col("unique_key").isNull()).withColumns(
            stamped | {"detected_at": now}
        )
        return {"quarantine": appended(head, "quarantine", store.write_days("quarantine", head, rows))}

    # The tables do not depend on each other, so their jobs share the cluster.
    tables = dict(head["tables"])
    with ThreadPoolExecutor(4) as pool:
        writers = (write_served, write_payloads, write_failures, write_quarantine)
        for written in pool.map(lambda write: write(), writers):
            tables |= written

    watermark = head["watermark"]
    if counts["max_updated_at"] is not None:
        reached = counts["max_updated_at"] + timedelta(milliseconds=1)
        text = reached.astimezone(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
        watermark = max(watermark or text, text)
    batches = head["batches"] | ({batch[0]: batch[1]} if batch else {})
    store.commit(head, tables=tables, watermark=watermark, batches=batches)

    inserted = by_change.get("insert", 0)
    return {
        "pages_fetched": 1,
        "rows_fetched": counts["rows_fetched"],
        "rows_inserted": inserted,
        "rows_updated": counts["rows_accepted"] - inserted - by_change.get("stale", 0),
        "rows_rejected": counts["rows_rejected"],
        "rows_flagged": counts["rows_flagged"],
        "duplicates_collapsed": links["total"],
        "links_new": links["new"],
        "unrecognized_types": counts["unrecognized_types"],
    }


def prune(store: SnapshotStore, cfg: RunConfig) -> dict[str, int]:
    """Retention of all tables in one commit; the daily table is never pruned.

    Whole days outside a window are dropped from the commit record; only the day the cutoff falls
    into is rewritten.
    """
    head, now = store.head(), cfg.as_of_col
    windows = {
        "raw": ("ingested_at", cfg.raw_retention_days),
        "failures": ("detected_at", cfg.raw_retention_days),
        "quarantine": ("detected_at", cfg.raw_retention_days),
        "clean": ("created_date", cfg.clean_retention_days),
        "runs": ("started_at", cfg.run_retention_days),
    }
    tables, pruned, frozen = dict(head["tables"]), {}, set(head["frozen_days"])
    for table, (time, days) in windows.items():
        edge = (cfg.as_of - (cfg.as_of.utcoffset() or timedelta()) - timedelta(days=days)).strftime("%Y-%m-%d")
        old = [d for d in store.days(head, table) if d <= edge]
        rows = store.read(table, head, old)
        lost = rows.where(~retention.keeps(time, now, days)).groupBy("part").count().collect()
        pruned[table] = sum(r["count"] for r in lost)
        if not pruned[table]:
            continue
        hit = [r["part"] for r in lost]
        # Of the days that lost rows only the one of the cutoff has rows left.
        left = retention.prune(store.read(table, head, [edge]), time, now, days)
        written = store.write_days(table, head, left) if edge in hit else []
        tables[table] = replaced(head, table, hit, written)
        if table == "clean":
            frozen.update(hit)
    if any(pruned.values()):
        store.commit(head, tables=tables, frozen_days=sorted(frozen))
    return pruned


def _log_run(store: SnapshotStore, head: dict, run: dict, **changes) -> None:
    """Writes the state of one run into the run log, in place of its earlier state."""
    day = run["started_at"].strftime("%Y-%m-%d")

    def literal(name: str) -> Column:
        value = run.get(name)
        return timestamp_literal(value) if isinstance(value, datetime) else F.lit(value)

    others = store.read("runs", head, [day]).where(F.col("id") != run["id"])
    types = {f.name: f.dataType for f in others.schema.fields if f.name != "part"}
    row = store.spark.range(1).select(
        *[literal(n).cast(t).alias(n) for n, t in types.items()], F.lit(day).alias("part")
    )
    days = store.write_days("runs", head, others.unionByName(row))
    tables = head["tables"] | {"runs": replaced(head, "runs", [day], days)}
    store.commit(head, tables=tables, **changes)


def _watermark(head: dict) -> datetime | None:
    return datetime.fromisoformat(head["watermark"]) if head["watermark"] else None


def _run(store: SnapshotStore, cfg: RunConfig, trigger: str, work) -> dict:
    """Opens a run, prunes, does ``work(run_id, watermark, counters)`` and closes the run.

    First it deletes the files that earlier runs replaced or pruned, so a reader of the latest
    commit keeps its files until the next run after it begins.
    """
    store.vacuum()
    head = store.head()
    before = _watermark(head) or cfg.as_of - timedelta(days=cfg.start_days_back)
    counters = dict.fromkeys(RUN_COUNTERS, 0)
    clock = datetime.now(timezone.utc)
    run = {
        "id": head["next_run"],
        "started_at": cfg.as_of,
        "status": "running",
        "trigger": trigger,
        "watermark_before": before,
    }
    _log_run(store, head, run | counters, next_run=head["next_run"] + 1)
    # What stays if the run is interrupted rather than failing by itself.
    error, status = "interrupted", "failed"
    try:
        lost = prune(store, cfg)
        counters["raw_pruned"], counters["clean_pruned"] = lost["raw"], lost["clean"]
        work(run["id"], before, counters)
        error, status = None, "success"
    except Exception as problem:
        error = f"{type(problem).__name__}: {problem}"
        # Partial when rows already landed: the next run goes on from there.
        landed = counters["rows_inserted"] or counters["rows_updated"]
        status = "partial" if landed else "failed"
        raise
    finally:
        took = (datetime.now(timezone.utc) - clock).total_seconds()
        after = store.head()
        closed = {
            "status": status,
            "finished_at": cfg.as_of + timedelta(seconds=took),
            "watermark_after": _watermark(after) or before,
            "duration_seconds": took,
            "error": error,
        }
        _log_run(store, after, run | counters | closed)
    return {"run_id": run["id"], "status": status, **counters}


def _add(counters: dict, batch: dict | None) -> None:
    for name, n in (batch or {}).items():
        counters[name] += n


def _start(cfg: RunConfig, before: datetime, reset_watermark: bool) -> datetime:
    return cfg.as_of - timedelta(days=cfg.start_days_back) if reset_watermark else before


def _updated_since(feed: DataFrame, start: datetime) -> DataFrame:
    # A record without any update time cannot be placed in time and is always looked at.
    return feed.where(F.coalesce(update_time(feed) >= timestamp_literal(start), F.lit(True)))


def run_batch(
    store: SnapshotStore,
    feed: DataFrame,
    cfg: RunConfig,
    trigger: str = "manual",
    reset_watermark: bool = False,
    polygons: DataFrame | None = None,
) -> dict:
    """One run over the records of ``feed`` updated since the watermark, as a single batch."""

    def work(run_id: int, before: datetime, counters: dict) -> None:
        recent = _updated_since(feed, _start(cfg, before, reset_watermark))
        _add(counters, apply_batch(store, recent, cfg, run_id, polygons=polygons))

    return _run(store, cfg, trigger, work)


def run_landed(
    store: SnapshotStore,
    landing: str,
    cfg: RunConfig,
    layout: str = "lines",
    trigger: str = "manual",
    reset_watermark: bool = False,
    polygons: DataFrame | None = None,
) -> dict:
    """As :func:`run_batch`, over a landing folder; of one laid out by day of arrival only the
    days that may hold records updated since the watermark are read."""

    def work(run_id: int, before: datetime, counters: dict) -> None:
        start = _start(cfg, before, reset_watermark)
        rows = read_feed(store.spark, landing, layout, first_arrival(start))
        recent = _updated_since(rows, start)
        _add(counters, apply_batch(store, recent, cfg, run_id, polygons=polygons))

    return _run(store, cfg, trigger, work)


def run_stream(
    store: SnapshotStore,
    landing: str,
    cfg: RunConfig,
    name: str = "feed",
    layout: str = "lines",
    trigger: str = "schedule",
    polygons: DataFrame | None = None,
) -> dict:
    """One run over the files that are new in the landing folder, in micro-batches.

    The file source's checkpoint remembers what was read; a record that arrives late is simply a
    revision, so nothing is dropped by event time. After :func:`reset_watermark` a new checkpoint
    begins, and what has arrived since the reset watermark is read once more.
    """

    def work(run_id: int, before: datetime, counters: dict) -> None:
        head = store.head()
        replays = head.get("replays", 0)
        source = f"{name}-{replays}" if replays else name

        def each(rows: DataFrame, number: int) -> None:
            _add(counters, apply_batch(store, rows, cfg, run_id, (source, number), polygons))

        rows = stream_feed(
            store.spark, landing, layout, cfg.max_files_per_trigger, head.get("replay_from")
        )
        stream = (
            rows.writeStream.foreachBatch(each)
            .option("checkpointLocation", f"{store.root}/checkpoints/{source}")
            .trigger(availableNow=True)
            .start()
        )
        stream.awaitTermination()

    return _run(store, cfg, trigger, work)


def reset_watermark(store: SnapshotStore, cfg: RunConfig, days_back: int | None = None) -> datetime:
    """Moves the watermark back, for batch scans and streams alike."""
    days = cfg.start_days_back if days_back is None else days_back
    moment = cfg.as_of - timedelta(days=days)
    head = store.head()
    store.commit(
        head,
        watermark=moment.strftime("%Y-%m-%d %H:%M:%S.%f"),
        replays=head.get("replays", 0) + 1,
        replay_from=first_arrival(moment),
    )
    return moment


def rebuild_days(store: SnapshotStore, cfg: RunConfig, days: int) -> list[str]:
    """Rolls up the last days again, as after a rule change. Frozen days keep their figures."""
    head = store.head()
    first = (cfg.as_of - timedelta(days=days)).strftime("%Y-%m-%d")
    open_days = [
        d for d in store.days(head, "clean") if d >= first and d not in head["frozen_days"]
    ]
    fresh = rollup.rollup(store.read("clean", head, open_days)).withColumns(
        {"computed_at": cfg.as_of_col, "part": _day("day")}
    )
    written = store.write_days("daily", head, fresh)
    tables = head["tables"] | {"daily": replaced(head, "daily", open_days, written)}
    store.commit(head, tables=tables)
    return open_days
