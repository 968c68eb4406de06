"""The driver's queries: one per operator, over the delivered tables or tables derived from them.

Every query takes (spark, sf_dir) and runs over whole tables. Times are given as text so that both
engines show them alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import RunConfig, configure, new_run_dir, timestamp_literal
from tidemark.functions import geo, text, times
from tidemark.operators import daily_state, duplicates, incremental, places, retention, rollup, upsert, validate
from tidemark.operators.lookup import literal_table
from tidemark.operators.standardize import canonicalize_category, standardize
from tidemark.plans import derived, reports
from tidemark.schema import RUN_COUNTERS
from tidemark.sources import boundaries, feed
from tidemark.sources.bucketed import BucketedTable
from tidemark.sources.day_table import DayTable
from tidemark.sources.snapshots import SnapshotStore
from tidemark.sources.staging import written, written_by_day
from tidemark.streaming import ingest
from tidemark.streaming.live_clusters import LiveClusters
from tidemark.streaming.newest import NewestRevisions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Fixed values of the query set, repeated in the SQL.
WATERMARK = "2024-01-25 00:00:00"
ORDERS_AS_OF = "2000-01-01 00:00:00"
SWEEP_MINUTES = [5, 15, 60, 240, 1440]
EVENT_GROUP = ("event_type", "user_id")

# Five overlapping boxes (name, west, south, east, north), in order of preference.
BOXES = [
    ("MANHATTAN", -74.0205, 40.6995, -73.9105, 40.8205),
    ("BRONX", -73.9305, 40.7855, -73.7605, 40.9155),
    ("BROOKLYN", -74.0405, 40.5705, -73.8505, 40.7395),
    ("QUEENS", -73.9605, 40.5415, -73.7005, 40.8005),
    ("STATEN ISLAND", -74.2555, 40.4965, -74.0525, 40.6485),
]


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def when_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived.read(spark, sf_dir, "events")
    return events.withColumn("unique_key", F.col("event_id").cast("string"))


def _day_text(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


# ---- standardization -----------------------------------------------------------------------


@query
def standardize_feed(spark, sf_dir):
    rows = standardize(derived.landed(spark, sf_dir), keep=("event_id",))
    return rows.select(
        "event_id",
        "unique_key",
        *[when_text(c).alias(c) for c in ("created_date", "closed_date", "source_updated_at")],
        "complaint_type",
        "complaint_type_norm",
        "known_category",
        "status",
        "borough",
        "incident_zip",
        "incident_address",
        "address_norm",
        "latitude",
        "longitude",
    )


@query
def clean_document_text(spark, sf_dir):
    whole = text.collapse_spaces(F.col("text"))
    docs = derived.read(spark, sf_dir, "documents").select("doc_id", whole.alias("whole"))
    return docs.select(
        "doc_id",
        text.cut(F.col("whole")).alias("cleaned"),
        text.cut(F.col("whole"), 2000).alias("cut_2000"),
        F.length("whole").cast("bigint").alias("whole_length"),
        F.md5("whole").alias("whole_md5"),
    )


@query
def category_canonical_counts(spark, sf_dir):
    labels = derived.landed(spark, sf_dir).select(
        F.nullif(
            text.category_key(text.collapse_spaces(F.col("complaint_type"))), F.lit("")
        ).alias("category_key")
    )
    return (
        canonicalize_category(labels)
        .groupBy("complaint_type_norm", "known_category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def address_key_counts(spark, sf_dir):
    keys = derived.landed(spark, sf_dir).select(
        text.address_key(F.col("incident_address")).alias("address_norm")
    )
    return keys.groupBy("address_norm").agg(F.count(F.lit(1)).alias("n"))


# ---- validation ----------------------------------------------------------------------------


@query
def validation_failures(spark, sf_dir):
    return validate.failure_rows(derived.validated_now(spark, sf_dir), "event_id", "unique_key")


@query
def rule_counts_zero_filled(spark, sf_dir):
    rows = derived.validated(spark, sf_dir)
    counted = validate.rule_counts(rows).join(
        rows.agg(F.count(F.lit(1)).alias("rows_fetched")), how="left"
    )
    return reports.rule_report(counted, F.col("rows_fetched"))


@query
def stored_rule_report(spark, sf_dir):
    rows = derived.validated(spark, sf_dir)
    failures = validate.failure_rows(rows, "unique_key")
    counted = reports.stored_rule_counts(failures).join(
        rows.agg(F.count(F.lit(1)).alias("rows_fetched")), how="left"
    )
    return reports.rule_report(counted, F.col("rows_fetched"))


@query
def accepted_rejected_split(spark, sf_dir):
    counters = validate.run_counters(derived.validated(spark, sf_dir))
    return counters.withColumn("max_updated_at", when_text("max_updated_at"))


@query
def observed_counters(spark, sf_dir):
    """Counters of the checked batch, taken while its rows are written."""
    rows, told = validate.observed(derived.validated_now(spark, sf_dir))
    rows.write.format("noop").mode("overwrite").save()
    found = told()
    newest = found.pop("max_updated_at")
    counts = [F.lit(v).cast("bigint").alias(k) for k, v in found.items()]
    at = timestamp_literal(newest) if newest else F.lit(None).cast("timestamp")
    return spark.range(1).select(*counts, when_text(at).alias("max_updated_at"))


@query
def record_verdicts(spark, sf_dir):
    return derived.validated(spark, sf_dir).select(
        "event_id",
        "is_rejected",
        F.col("defect_count").cast("bigint").alias("defect_count"),
        F.size("failures").cast("bigint").alias("failure_count"),
        "zip_borough_conflict",
        "unrecognized_type",
    )


@query
def orders_date_rules(spark, sf_dir):
    """Date rules with the first ship date of an order as its close."""
    lines = derived.read(spark, sf_dir, "lineitem")
    shipped = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("closed_date")
    )
    orders = (
        derived.read(spark, sf_dir, "orders")
        .select("o_orderkey", F.col("o_orderdate").alias("created_date"))
        .join(shipped, "o_orderkey", "left")
    )
    rules = validate.builtin_checks(timestamp_literal(ORDERS_AS_OF), orders.columns)
    dated = validate.apply_checks(orders, {c: rules[c] for c in ("dates", "future")})
    return validate.failure_rows(dated, "o_orderkey")


@query
def replay_rules(spark, sf_dir):
    """Stored failures of rules checked without a clock, against a replay of the payloads."""
    rows = derived.landed(spark, sf_dir).where(F.col("unique_key").isNotNull())
    payloads = rows.select("unique_key", F.to_json(F.struct(*rows.columns)).alias("payload"))
    stored = validate.failure_rows(derived.validated(spark, sf_dir), "unique_key").where(
        F.col("unique_key").isNotNull() & (F.col("rule") != "zip_outside_nyc")
    )
    return validate.replay(payloads, stored)


# ---- places --------------------------------------------------------------------------------


@query
def zip_borough_range_join(spark, sf_dir):
    rows = derived.validated(spark, sf_dir).select("event_id", "incident_zip", "borough")
    zip5, found = F.col("incident_zip"), F.col("zip_borough")
    return places.join_zip_borough(rows, "incident_zip").select(
        "event_id",
        "incident_zip",
        "borough",
        "zip_borough",
        geo.zip_in_city(zip5, found).alias("in_city"),
        geo.zip_matches_borough(zip5, found, F.col("borough")).cast("string").alias("agrees"),
    )


@query
def coordinate_classes(spark, sf_dir):
    lat, lon = F.col("latitude"), F.col("longitude")
    return derived.validated(spark, sf_dir).select(
        "event_id",
        geo.coordinate_class(lat, lon).alias("coordinate_class"),
        geo.in_city_box(lat, lon).alias("in_box"),
        geo.is_zero_point(lat, lon).alias("zero_point"),
        geo.looks_swapped(lat, lon).alias("swapped"),
    )


@query
def pair_distance(spark, sf_dir):
    """Distance between a point of the order and a point of its customer's nation."""
    orders = derived.read(spark, sf_dir, "orders").join(
        derived.read(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_nationkey"
        ),
        "o_custkey",
    )
    key, nation = F.col("o_orderkey"), F.col("c_nationkey")
    km = geo.distance_km(
        (key % 1700) / F.lit(10.0) - 85.0,
        (key % 3590) / F.lit(10.0) - 179.0,
        nation * F.lit(5.0) - 60.0,
        nation * F.lit(12.0) - 150.0,
    )
    return orders.select("o_orderkey", F.round(km, 5).alias("km"))


def _box_polygons(spark: SparkSession) -> DataFrame:
    rows = [(name, i, w, s, e, n) for i, (name, w, s, e, n) in enumerate(BOXES)]
    boxes = literal_table(spark, ["borough", "ord", "w", "s", "e", "n"], rows)
    corners = [("w", "s"), ("e", "s"), ("e", "n"), ("w", "n"), ("w", "s")]
    return boxes.select(
        "borough",
        F.col("ord").cast("bigint").alias("ord"),
        F.array(*[F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for x, y in corners]).alias("ring"),
    )


@query
def point_in_polygon(spark, sf_dir):
    """Feed records moved onto a grid of points, then checked against five polygons."""
    key = F.col("event_id")
    rows = derived.validated(spark, sf_dir).select(
        "event_id",
        "borough",
        "incident_zip",
        (F.lit(40.45) + (key % 487) / F.lit(1000.0)).alias("latitude"),
        (F.lit(-74.28) + (key % 613) / F.lit(1000.0)).alias("longitude"),
    )
    found = places.locate_points(rows, _box_polygons(spark)).withColumn(
        "zip_borough", geo.borough_of_zip(F.col("incident_zip"))
    )
    place = validate.builtin_checks(None, found.columns)["place"]
    checked = validate.apply_checks(found, {"place": place})
    return checked.select("event_id", "found_borough", F.col("check_place").alias("failed_rule"))


def _nation_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text: a feature a region with a box a nation, and one of another name that spans the world.
    The features are as many as there are regions, the boxes as nations."""
    nations = derived.read(spark, sf_dir, "nation").join(
        derived.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    west, south = F.col("n_nationkey") * 12 - 150, F.col("n_regionkey") * 20 - 50
    corners = [(west, south), (west + 10, south), (west + 10, south + 15), (west, south + 15), (west, south)]
    ring = F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in corners])
    multi = F.collect_list(F.struct("n_nationkey", F.array(ring).alias("polygon")))
    regions = nations.groupBy("r_name").agg(F.sort_array(multi).alias("m")).select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(F.lower("r_name").alias("boro_name")).alias("properties"),
                F.struct(F.lit("MultiPolygon").alias("type"), F.col("m.polygon").alias("coordinates")).alias("geometry"),
            )
        ).alias("feature")
    )
    world = (
        '{"type":"Feature","properties":{"BoroName":"Everywhere"},"geometry":{"type":"Polygon",'
        '"coordinates":[[[-180,-90],[180,-90],[180,90],[-180,90],[-180,-90]]]}}'
    )
    features = F.array_join(F.concat(F.array(F.lit(world)), F.sort_array(F.collect_list("feature"))), ",\n")
    return regions.agg(F.concat(F.lit('{"type":"FeatureCollection","features":[\n'), features, F.lit("\n]}")).alias("value"))


@query
def boundary_regions(spark, sf_dir):
    """Customers by the region whose boundary holds their point, the boundaries built from a GeoJSON file."""

    def fill(root: str) -> None:
        _nation_geojson(spark, sf_dir).coalesce(1).write.text(f"{root}/geojson")
        names = [r.r_name for r in derived.read(spark, sf_dir, "region").select("r_name").distinct().collect()]
        boundaries.build_boundaries(spark, f"{root}/geojson", f"{root}/rings", names)

    rings = boundaries.load_boundaries(spark, derived.once(spark, sf_dir, "boundaries", fill) + "/rings")
    key = F.col("c_custkey")
    points = derived.read(spark, sf_dir, "customer").select(
        "c_custkey",
        (key * 7 % 3000 / F.lit(10.0) - 149.95).alias("longitude"),
        (key * 13 % 1000 / F.lit(10.0) - 49.97).alias("latitude"),
    )
    return places.locate_points(points, rings).select("c_custkey", F.col("found_borough").alias("found_region"))


# ---- duplicates ----------------------------------------------------------------------------


@query
def dup_links_events(spark, sf_dir):
    return duplicates.link_duplicates(
        _events(spark, sf_dir), derived.DEDUP_MINUTES, EVENT_GROUP, "ts"
    )


@query
def dup_links_feed(spark, sf_dir):
    rows = validate.accepted(derived.validated(spark, sf_dir))
    return duplicates.link_duplicates(rows, derived.DEDUP_MINUTES)


@query
def cluster_sizes(spark, sf_dir):
    links = duplicates.link_duplicates(_events(spark, sf_dir), 1440, EVENT_GROUP, "ts")
    return duplicates.cluster_sizes(links)


@query
def dedup_window_sweep(spark, sf_dir):
    return duplicates.sweep_windows(_events(spark, sf_dir), SWEEP_MINUTES, EVENT_GROUP, "ts")


@query
def dedup_sweep_recent(spark, sf_dir):
    recent = duplicates.candidates(derived.served(spark, sf_dir), derived.as_of(), 20)
    return duplicates.sweep_windows(recent, SWEEP_MINUTES)


@query
def neighbour_band_join(spark, sf_dir):
    """Events within twice the window of an event that came after the watermark."""
    events = _events(spark, sf_dir)
    touched = events.where(F.col("ts") >= timestamp_literal(WATERMARK))
    return duplicates.neighbours(events, touched, 720, EVENT_GROUP, "ts").select(
        "event_id", "event_type", "user_id", when_text("ts").alias("ts")
    )


@query
def apply_links(spark, sf_dir):
    rows = validate.accepted(derived.validated(spark, sf_dir))
    links = duplicates.link_duplicates(rows, 240)
    return duplicates.apply_links(rows, links).select("unique_key", "is_duplicate_of")


def _watched(spark: SparkSession, sf_dir: str) -> LiveClusters:
    """Live clusters of the events, streamed in two runs; every tenth event of the day before the
    watermark comes late, with the second."""
    root = derived.once(spark, sf_dir, "live", lambda folder: _watch(spark, sf_dir, folder))
    return LiveClusters(spark, root, derived.DEDUP_MINUTES, "2 days", EVENT_GROUP, "ts")


def _watch(spark: SparkSession, sf_dir: str, root: str) -> None:
    events = _events(spark, sf_dir).select("event_id", "unique_key", *EVENT_GROUP, "ts")
    edge = timestamp_literal(WATERMARK)
    late = (F.col("ts") >= edge - F.expr("INTERVAL 1 DAY")) & (F.col("event_id") % 10 == 0)
    second = (F.col("ts") >= edge) | late
    live = LiveClusters(spark, root, derived.DEDUP_MINUTES, "2 days", EVENT_GROUP, "ts")
    for part in (events.where(~second), events.where(second)):
        part.write.mode("append").parquet(f"{root}/landing")
        live.run(spark.readStream.schema(events.schema).parquet(f"{root}/landing"))


@query
def live_clusters(spark, sf_dir):
    """Clusters of the events as a stream counted them: closed ones, and open ones from its state."""
    return _watched(spark, sf_dir).all().select(
        *EVENT_GROUP,
        when_text("first_at").alias("first_at"),
        when_text("last_at").alias("last_at"),
        "survivor",
        "members",
    )


def _moves(rows: DataFrame, revision: int) -> DataFrame:
    """Events as a later revision has them: from the first on every fifth comes 90 minutes later, in
    the second every seventh belongs to another user."""
    later = F.when(F.col("event_id") % 5 == 0, F.col("ts") + F.expr("INTERVAL 90 MINUTES"))
    other = F.when(F.col("event_id") % 7 == 0, F.col("user_id") % 5)
    moved = {"ts": F.coalesce(later, "ts")} | ({"user_id": F.coalesce(other, "user_id")} if revision > 1 else {})
    return rows.withColumns(moved)


@query
def incremental_links(spark, sf_dir):
    """Links of events after three batches, each batch walked outward from what it touched: the events
    before the watermark, then the others with the first revision, then the second."""
    columns = ["unique_key", *EVENT_GROUP, "ts"]
    events = _events(spark, sf_dir).select("event_id", *columns)
    stored = events.where(F.col("ts") < timestamp_literal(WATERMARK))
    now = [stored.select(*columns), _moves(events, 1).select(*columns), _moves(events, 2).select(*columns)]
    links = duplicates.mark_duplicates(now[0], derived.DEDUP_MINUTES, EVENT_GROUP, "ts")
    links = links.select("unique_key", "is_duplicate_of")
    for batch in (1, 2):
        was, new = now[batch - 1], now[batch]
        changed = written(new.join(was, columns, "left_anti").select(*columns), f"changed-{batch}")
        gone = was.join(changed.select("unique_key"), "unique_key", "left_semi")
        table = written_by_day(new, "ts", f"events-{batch}")
        walked = incremental.relink(
            lambda days, t=table: t.where(F.col("part").isin(days)),
            changed.unionByName(gone.select(*columns)),
            derived.DEDUP_MINUTES,
            EVENT_GROUP,
            "ts",
        )
        fresh = written(walked.select("unique_key", "is_duplicate_of"), f"links-{batch}")
        links = links.join(fresh, "unique_key", "left_anti").unionByName(fresh)
    return links


# ---- revisions and upserts -----------------------------------------------------------------


@query
def latest_revision(spark, sf_dir):
    """Latest line per (order, line number) by ship date; ties by the remaining columns."""
    lines = derived.read(spark, sf_dir, "lineitem")
    ties = (
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
    )
    newest = upsert.latest_revision(
        lines, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), *[F.desc(c) for c in ties]]
    )
    return newest.select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        when_text("l_shipdate").alias("l_shipdate"),
    )


_LINE_KEYS = ("l_orderkey", "l_linenumber")
_LINE_RANK = (
    "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
)


def _line_revisions(spark: SparkSession, sf_dir: str) -> NewestRevisions:
    """Lines streamed in three batches by a hash, so that newer and stale ones come in any order."""

    def at(root: str) -> NewestRevisions:
        return NewestRevisions(spark, root, _LINE_KEYS, "l_shipdate", _LINE_RANK)

    def fill(root: str) -> None:
        columns = [*_LINE_KEYS, "l_shipdate", *_LINE_RANK]
        lines = derived.read(spark, sf_dir, "lineitem").select(*columns)
        third = F.pmod(F.xxhash64(*columns), F.lit(3))
        for n in range(3):
            lines.where(third == n).write.mode("append").parquet(f"{root}/landing")
            at(root).run(spark.readStream.schema(lines.schema).parquet(f"{root}/landing"))

    return at(derived.once(spark, sf_dir, "line-revisions", fill))


@query
def stream_latest_revision(spark, sf_dir):
    """As ``latest_revision``, from the state of a stream."""
    return _line_revisions(spark, sf_dir).current().select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        when_text("l_shipdate").alias("l_shipdate"),
    )


@query
def upsert_insert_update(spark, sf_dir):
    """Orders before 1998 are stored; those from 1996 on come in, priced anew."""
    orders = derived.read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    stored = orders.where(F.col("o_orderdate") < timestamp_literal("1998-01-01 00:00:00"))
    # Orders in progress come in with an older update time and must not win.
    late = F.when(F.col("o_orderstatus") == "P", -1).otherwise(1)
    incoming = orders.where(F.col("o_orderdate") >= timestamp_literal("1996-01-01 00:00:00")).withColumns(
        {
            "o_totalprice": F.col("o_totalprice") + 1,
            "o_orderdate": F.col("o_orderdate") + F.make_dt_interval(late),
        }
    )
    merged = upsert.upsert(stored, incoming, "o_orderkey", "o_orderdate")
    return merged.select(
        "o_orderkey",
        "change",
        F.round("o_totalprice", 2).alias("o_totalprice"),
        when_text("o_orderdate").alias("o_orderdate"),
    )


def _order_revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders before 1998, and those from 1996 on priced anew; of these, orders in progress carry
    an older time and must not win."""
    orders = derived.read(spark, sf_dir, "orders")
    stored = orders.where(F.col("o_orderdate") < timestamp_literal("1998-01-01 00:00:00"))
    late = F.when(F.col("o_orderstatus") == "P", -1).otherwise(1)
    incoming = orders.where(F.col("o_orderdate") >= timestamp_literal("1996-01-01 00:00:00"))
    newer = {
        "o_totalprice": F.col("o_totalprice") + 1,
        "o_orderdate": F.col("o_orderdate") + F.make_dt_interval(late),
    }
    return stored, incoming.withColumns(newer)


ORDER_BUCKETS = 16


def _served_orders(spark: SparkSession, sf_dir: str) -> tuple[BucketedTable, DataFrame]:
    """The bucketed table after the upsert, and the changes of that batch."""

    def fill(root: str) -> None:
        stored, incoming = _order_revisions(spark, sf_dir)
        table = _table_at(root).create(stored)
        changes = table.classified(incoming)
        changes.write.parquet(f"{root}/changes")
        table.upsert(spark.read.parquet(f"{root}/changes"))

    def _table_at(root: str) -> BucketedTable:
        name = "orders_" + root.rstrip("/").rsplit("-", 1)[-1]
        return BucketedTable(spark, name, root, "o_orderkey", "o_orderdate", ORDER_BUCKETS)

    root = derived.once(spark, sf_dir, "served-orders", fill)
    return _table_at(root), spark.read.parquet(f"{root}/changes")


@query
def bucketed_upsert(spark, sf_dir):
    """As ``upsert_insert_update``, on a bucketed table that takes in the batch alone."""
    table, changes = _served_orders(spark, sf_dir)
    told = changes.where("change <> 'stale'").select("o_orderkey", "change")
    return (
        table.newest()
        .join(told, "o_orderkey", "left")
        .select(
            "o_orderkey",
            F.coalesce("change", F.lit("kept")).alias("change"),
            F.round("o_totalprice", 2).alias("o_totalprice"),
            when_text("o_orderdate").alias("o_orderdate"),
        )
    )


@query
def order_lookup(spark, sf_dir):
    """The order with the largest key, from the bucket that may hold it."""
    table, _ = _served_orders(spark, sf_dir)
    largest = derived.read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return table.lookup(largest).select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        F.round("o_totalprice", 2).alias("o_totalprice"),
        when_text("o_orderdate").alias("o_orderdate"),
    )


@query
def raw_keep_seen_count(spark, sf_dir):
    """Flagged payloads of records updated by the watermark, then the whole feed on top."""
    props = derived.read(spark, sf_dir, "events").select("event_id", "props")
    rows = derived.validated(spark, sf_dir).join(props, "event_id")
    failed = validate.any_failure(rows)
    early = rows.where(F.col("source_updated_at") < timestamp_literal(WATERMARK))
    stored = upsert.flagged_payloads(early, F.col("props"), failed)
    incoming = upsert.flagged_payloads(rows, F.col("props"), failed)
    return upsert.merge_payloads(stored, incoming).select(
        "unique_key", "payload", when_text("source_updated_at").alias("source_updated_at"), "seen_count"
    )


# ---- rollup --------------------------------------------------------------------------------


@query
def daily_rollup(spark, sf_dir):
    return _day_text(rollup.rollup(derived.served(spark, sf_dir)))


@query
def daily_by_differences(spark, sf_dir):
    """The daily table from a state that took in three batches: the records before the watermark as
    they were first sent, the others as first sent, then what became of all of them."""
    final = derived.served(spark, sf_dir)
    # As first sent, a record is open, without defects, and linked with none.
    sent = final.withColumns(
        {
            "closed_date": F.lit(None).cast("timestamp"),
            "is_duplicate_of": F.lit(None).cast("string"),
            "defect_count": F.lit(0),
        }
    )
    early = F.col("created_date") < timestamp_literal(WATERMARK)
    first = daily_state.state(sent.where(early))
    second = daily_state.state(sent.where(~early))
    third = daily_state.difference(sent, final)
    batches = [written(part, f"daily-state-{i}") for i, part in enumerate((first, second, third))]
    return _day_text(daily_state.daily(*batches))


@query
def daily_rollup_orders(spark, sf_dir):
    """Orders by day, customer region and priority; the first ship date closes an order."""
    shipped = (
        derived.read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("l_shipdate").alias("closed_date"))
    )
    places_of = (
        derived.read(spark, sf_dir, "customer")
        .select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
        .join(derived.read(spark, sf_dir, "nation"), "n_nationkey")
        .join(
            derived.read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"),
            "n_regionkey",
        )
        .select("o_custkey", F.col("r_name").alias("borough"))
    )
    orders = (
        derived.read(spark, sf_dir, "orders")
        .join(places_of, "o_custkey")
        .join(shipped, "o_orderkey", "left")
        .select(
            "borough",
            F.col("o_orderpriority").alias("complaint_type_norm"),
            F.col("o_orderdate").alias("created_date"),
            "closed_date",
            (F.col("closed_date") < F.col("o_orderdate")).cast("int").alias("defect_count"),
            F.lit(None).cast("string").alias("is_duplicate_of"),
        )
    )
    return _day_text(rollup.rollup(orders))


@query
def touched_day_rollup(spark, sf_dir):
    """Only the days of records updated since the watermark are rolled up again."""
    clean = derived.served(spark, sf_dir)
    touched = clean.where(F.col("source_updated_at") >= timestamp_literal(WATERMARK))
    days = rollup.days_of_keys(clean, touched)
    return _day_text(rollup.rollup_days(clean, days))


@query
def recent_day_rollup(spark, sf_dir):
    """Rebuild of the last days, laid over a daily table whose figures for them are wrong and which
    has a group that vanished."""
    clean, daily = derived.served(spark, sf_dir), derived.daily(spark, sf_dir)
    days = rollup.days_since(clean, derived.as_of(), 10)
    stale = daily.join(days, "day", "left_semi").withColumn(
        "request_count", F.col("request_count") + 7
    )
    vanished = stale.withColumn("borough", F.lit("VANISHED"))
    daily = daily.join(days, "day", "left_anti").unionByName(stale).unionByName(vanished)
    return _day_text(rollup.replace_days(daily, rollup.rollup_days(clean, days), days))


@query
def daily_by_dimension(spark, sf_dir):
    daily = derived.daily(spark, sf_dir)
    parts = [
        reports.daily_by(daily, derived.as_of(), 20, d).select(
            F.lit(d).alias("dimension"),
            F.col("key").cast("string").alias("key"),
            "request_count",
            "closed_count",
            "defect_count",
            "duplicate_count",
            F.col("avg_median_hours_to_close").cast("double").alias("avg_median_hours_to_close"),
        )
        for d in ("day", "borough", "complaint_type")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- read queries --------------------------------------------------------------------------


@query
def top_categories(spark, sf_dir):
    return reports.top_categories(derived.served(spark, sf_dir), 40)


@query
def borough_defect_rate(spark, sf_dir):
    return reports.borough_defects(derived.served(spark, sf_dir))


def _page_filter() -> Column:
    return reports.request_filter(
        borough="brooklyn", status="clo_ed", defects_only=True, since="2024-01-05"
    )


@query
def requests_page(spark, sf_dir):
    page = reports.requests_page(derived.served(spark, sf_dir), _page_filter(), 50, 25)
    return page.select(
        "unique_key",
        when_text("created_date").alias("created_date"),
        when_text("closed_date").alias("closed_date"),
        "complaint_type_norm",
        "status",
        "borough",
        "incident_zip",
        "incident_address",
        F.col("defect_count").cast("bigint").alias("defect_count"),
    )


@query
def requests_seek(spark, sf_dir):
    """The third page of 25, each page sought after the last record of the one before."""
    clean = derived.served(spark, sf_dir)
    last = None
    for _ in range(2):
        # The end of a page: its last row in its own order, at most one.
        page = reports.requests_after(clean, _page_filter(), last, 25)
        end = page.orderBy(F.asc_nulls_first("created_date"), F.desc("unique_key")).select("created_date", "unique_key").first()
        if end is None:
            break
        # With its zone, as the driver's own may be another.
        last = (end.created_date.astimezone(timezone.utc) if end.created_date else None, end.unique_key)
    return reports.requests_after(clean, _page_filter(), last, 25).select(
        "unique_key",
        when_text("created_date").alias("created_date"),
        "complaint_type_norm",
        "borough",
        F.col("defect_count").cast("bigint").alias("defect_count"),
    )


@query
def requests_total(spark, sf_dir):
    return reports.requests_total(derived.served(spark, sf_dir), _page_filter())


@query
def request_detail(spark, sf_dir):
    clean = derived.served(spark, sf_dir)
    failures = validate.failure_rows(derived.validated(spark, sf_dir), "unique_key")
    return reports.request_overview(clean, failures).select(
        "unique_key",
        "is_duplicate_of",
        "failure_count",
        "first_rule",
        "last_rule",
        "duplicate_count",
        when_text("first_duplicate_at").alias("first_duplicate_at"),
        when_text("last_duplicate_at").alias("last_duplicate_at"),
    )


@query
def quality_labels(spark, sf_dir):
    return derived.served(spark, sf_dir).select(
        "unique_key", F.array_join(reports.quality_labels(), ", ").alias("labels")
    )


@query
def store_totals(spark, sf_dir):
    clean, daily = derived.served(spark, sf_dir), derived.daily(spark, sf_dir)
    rows = derived.validated(spark, sf_dir)
    raw = rows.where(F.col("unique_key").isNotNull() & validate.any_failure(rows))
    totals = reports.store_totals(clean, raw, daily)
    return totals.withColumn("agg_since", F.col("agg_since").cast("string"))


DELIVERED = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query
def storage_report(spark, sf_dir):
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in DELIVERED}
    return reports.storage_report(tables, RunConfig(derived.AS_OF_TIME).storage_budget_bytes)


@query
def storage_rows(spark, sf_dir):
    """The part of the storage report that doesn't depend on how files are laid out."""
    return storage_report(spark, sf_dir).select("table_name", "row_count")


# ---- feed ----------------------------------------------------------------------------------


@query
def incremental_scan(spark, sf_dir):
    rows = feed.since(derived.arrivals(spark, sf_dir), timestamp_literal(WATERMARK))
    return rows.select("event_id", when_text("source_updated_at").alias("source_updated_at"))


@query
def next_watermark(spark, sf_dir):
    rows = feed.since(derived.arrivals(spark, sf_dir), feed.start_watermark(derived.as_of(), 3))
    return rows.agg(
        F.count(F.lit(1)).alias("rows_fetched"),
        when_text(feed.next_watermark(F.max("source_updated_at"))).alias("watermark"),
    )


@query
def drift_probe(spark, sf_dir):
    """Fields found in the JSON of events and of feed payloads, with their fill rates."""
    rows = derived.landed(spark, sf_dir)
    payloads = rows.select(F.to_json(F.struct(*rows.drop("event_id", "ts").columns)).alias("payload"))
    events = derived.read(spark, sf_dir, "events").select(F.col("props").alias("payload"))
    return feed.field_profile(payloads.unionByName(events))


@query
def feed_probe(spark, sf_dir):
    """One row about the landed feed; of the sample only its time, as several records may share it."""
    rows = derived.landed(spark, sf_dir)
    fields = rows.drop("event_id", "ts").columns
    probe = feed.feed_profile(rows.withColumn("payload", F.to_json(F.struct(*fields))))
    return probe.select(
        "rows_returned",
        "has_updated_at",
        when_text("newest_updated_at").alias("newest_updated_at"),
        F.get_json_object("sample", "$.updated_at").cast("bigint").alias("sample_updated_at"),
    )


@query
def time_spellings(spark, sf_dir):
    """Event times spelled in nine ways, read back: epochs with a fraction or nine digits, ISO to
    the hour, minute or day, with an offset, and two spellings that are refused."""
    ts, kind = F.col("ts"), F.col("event_id") % 9
    seconds = F.floor(F.unix_micros(ts) / 1_000_000)
    spelled = (
        F.when(kind == 0, F.concat(seconds.cast("string"), F.lit(".5")))
        .when(kind == 1, F.floor(seconds / 10).cast("string"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH"))
        .when(kind == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))
        .when(kind == 4, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 5, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+05:30'"))
        .when(kind == 6, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == 7, F.date_format(ts, "yyyyMMdd"))
        .otherwise(F.date_format(ts, "dd.MM.yyyy"))
    )
    read = derived.read(spark, sf_dir, "events").select("event_id", spelled.alias("t"))
    return read.select(
        "event_id",
        when_text(times.parse_time(F.col("t"))).alias("as_time"),
        when_text(times.parse_update_time(F.col("t"))).alias("as_update_time"),
    )


# ---- maintenance and run log ---------------------------------------------------------------


@query
def retention_counts(spark, sf_dir):
    windows = {"raw": 7, "clean": 21, "runs": 365}
    events = derived.read(spark, sf_dir, "events")
    return retention.prune_counts(events, "ts", derived.as_of(), windows)


@query
def day_table_counts(spark, sf_dir):
    """Events by day, from file footers, in a day table where the days from the watermark on were
    written again without every tenth event, and which retention then cut to 21 days."""

    def table_at(root: str) -> DayTable:
        return DayTable(spark, "events_" + root.rstrip("/").rsplit("-", 1)[-1], "ts")

    def fill(root: str) -> None:
        events = derived.read(spark, sf_dir, "events").select("event_id", "event_type", "ts")
        table = table_at(root).create("event_id BIGINT, event_type STRING, ts TIMESTAMP")
        table.replace_days(events)
        table.replace_days(events.where((F.col("ts") >= timestamp_literal(WATERMARK)) & (F.col("event_id") % 10 != 0)))
        table.prune(derived.AS_OF_TIME - timedelta(days=21))

    table = table_at(derived.once(spark, sf_dir, "day-table", fill))
    return table.counts().select(F.col("part").alias("day"), F.col("rows").alias("n"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per event day: its counters come from the day's events."""
    events = derived.read(spark, sf_dir, "events")
    kind = F.col("event_type")
    counted = {
        "rows_fetched": F.count(F.lit(1)),
        "rows_inserted": F.count_if(kind.isin("click", "view")),
        "rows_updated": F.count_if(kind == "purchase"),
        "rows_rejected": F.count_if(kind == "error"),
        "rows_flagged": F.count_if(F.col("value") > 20),
        "duplicates_collapsed": F.count_if(kind == "signup"),
    }
    days = events.groupBy(F.to_date("ts").alias("day")).agg(
        F.max("ts").alias("finished_at"), *[c.alias(n) for n, c in counted.items()]
    )
    number = F.dayofmonth("day")
    return days.select(
        number.cast("bigint").alias("id"),
        F.col("day").cast("timestamp").alias("started_at"),
        "finished_at",
        F.when(number % 7 == 0, "partial")
        .when(number % 11 == 0, "failed")
        .otherwise("success")
        .alias("status"),
        *counted,
        *[F.lit(0).cast("bigint").alias(c) for c in RUN_COUNTERS if c not in counted],
    )


@query
def run_log_delta(spark, sf_dir):
    return reports.run_deltas(_runs(spark, sf_dir)).select(
        "id",
        "status",
        when_text("started_at").alias("started_at"),
        "rows_fetched",
        *[F.col(f"{c}_change").cast("double").alias(f"{c}_change") for c in reports.DELTA_COUNTERS],
    )


@query
def last_day_totals(spark, sf_dir):
    return reports.last_day_totals(
        _runs(spark, sf_dir), timestamp_literal("2024-01-28 12:00:00")
    )


@query
def recent_runs(spark, sf_dir):
    return reports.recent_runs(_runs(spark, sf_dir), 10).select(
        "id", "status", when_text("finished_at").alias("finished_at"), "rows_fetched"
    )


@query
def freshness(spark, sf_dir):
    return reports.health(_runs(spark, sf_dir), timestamp_literal("2024-01-30 18:30:00"))


@query
def run_status(spark, sf_dir):
    return reports.status(_runs(spark, sf_dir), derived.as_of()).select(
        "id", "status", when_text("finished_at").alias("finished_at"), "minutes_since_last_success"
    )


# ---- the whole run -------------------------------------------------------------------------


LANDED_FILES = 16


def _land(rows: DataFrame, landing: str) -> None:
    """Writes JSON lines (``value``) into a folder a day of arrival, one file each however large, so that as
    many micro-batches come of them as the days need: every batch writes anew what it touches, and
    batches that grow in number with the rows would make that quadratic. Text is split when it is read."""
    rows.repartition(feed.ARRIVED).write.partitionBy(feed.ARRIVED).text(landing)


def _streamed(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """A store filled by streaming the landed feed, written as one folder of JSON per day."""
    key = (spark.sparkContext.applicationId, sf_dir, "stream")
    if key not in derived._written:
        rows = derived.landed(spark, sf_dir)
        fields = rows.drop("event_id", "ts").columns
        landing = new_run_dir(spark, "landing")
        _land(rows.select(F.to_json(F.struct(*fields)).alias("value"), F.to_date("ts").alias(feed.ARRIVED)), landing)
        # A folder a day: links and days span several micro-batches.
        cfg = RunConfig(derived.AS_OF_TIME, max_files_per_trigger=LANDED_FILES)
        root = new_run_dir(spark, "store")
        ingest.run_stream(SnapshotStore(spark, root), landing, cfg)
        derived._written[key] = root
    return SnapshotStore(spark, derived._written[key])


@query
def ingest_stream_clean(spark, sf_dir):
    return _streamed(spark, sf_dir).read("clean").select(
        "unique_key",
        when_text("created_date").alias("created_date"),
        "complaint_type_norm",
        "borough",
        "address_norm",
        F.col("defect_count").cast("bigint").alias("defect_count"),
        "is_duplicate_of",
    )


@query
def ingest_stream_failures(spark, sf_dir):
    return _streamed(spark, sf_dir).read("failures").select(
        "unique_key", "rule", "severity", "detail", "field_value"
    )


@query
def ingest_stream_daily(spark, sf_dir):
    return _day_text(_streamed(spark, sf_dir).read("daily").drop("part", "computed_at"))


@query
def ingest_stream_raw(spark, sf_dir):
    return _streamed(spark, sf_dir).read("raw").select(
        "unique_key",
        F.get_json_object("payload", "$.incident_address").alias("incident_address"),
        when_text("source_updated_at").alias("source_updated_at"),
        "seen_count",
    )


@query
def ingest_stream_quality(spark, sf_dir):
    """Counters of the latest run next to the store totals, from the quality report."""
    store = _streamed(spark, sf_dir)
    names = ("clean", "raw", "failures", "daily", "runs")
    report = reports.quality_report(
        spark, {n: store.read(n) for n in names}, derived.as_of() + F.expr("INTERVAL 1 HOUR")
    )
    run = report["latest_run"].select(
        "status", "rows_fetched", "rows_inserted", "rows_rejected", "rows_flagged"
    )
    totals = report["totals"].withColumn("agg_since", F.col("agg_since").cast("string"))
    return run.join(totals, how="left")


CLEAN_DAYS = 14


def _revised(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """A store filled by a feed that sends keys again, then pruned by a second run.

    Half a month later every fifth record comes back a day moved and newer, every 35th in a form
    that is rejected; a month later every third comes back at another address but older.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "revised")
    if key not in derived._written:
        rows = derived.landed(spark, sf_dir)
        fields = rows.drop("event_id", "ts").columns
        moved = F.col("created_date").try_cast("timestamp") + F.expr("INTERVAL 1 DAY")

        def sent(part: DataFrame, days: int) -> DataFrame:
            return part.withColumn("updated_at", F.col("updated_at").cast("string")).select(
                F.to_json(F.struct(*fields)).alias("value"),
                F.date_add(F.to_date("ts"), days).alias(feed.ARRIVED),
            )

        newer = rows.where("event_id % 5 = 0").withColumns(
            {
                "updated_at": F.col("updated_at").cast("bigint") + 86_400,
                "created_date": F.when(
                    F.col("event_id") % 35 != 0,
                    F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                ),
            }
        )
        older = rows.where("event_id % 3 = 0").withColumns(
            {
                "updated_at": F.col("updated_at").cast("bigint") - 86_400,
                "incident_address": F.lit("9 West 77th Street"),
            }
        )
        landing, root = new_run_dir(spark, "landing"), new_run_dir(spark, "store")
        _land(sent(rows, 0).unionByName(sent(newer, 15)).unionByName(sent(older, 30)), landing)
        store = SnapshotStore(spark, root)
        cfg = RunConfig(derived.AS_OF_TIME, max_files_per_trigger=LANDED_FILES)
        ingest.run_stream(store, landing, cfg)
        # Nothing new has landed for the second run; it only prunes.
        ingest.run_stream(store, landing, replace(cfg, clean_retention_days=CLEAN_DAYS))
        derived._written[key] = root
    return SnapshotStore(spark, derived._written[key])


@query
def ingest_revisions_clean(spark, sf_dir):
    return _revised(spark, sf_dir).read("clean").select(
        "unique_key",
        when_text("created_date").alias("created_date"),
        when_text("source_updated_at").alias("source_updated_at"),
        "address_norm",
        F.col("defect_count").cast("bigint").alias("defect_count"),
        "is_duplicate_of",
    )


@query
def ingest_revisions_daily(spark, sf_dir):
    """Daily figures keep what retention has taken from the served table."""
    return _day_text(_revised(spark, sf_dir).read("daily").drop("part", "computed_at"))


@query
def ingest_revisions_runs(spark, sf_dir):
    """Counters of both runs that don't depend on how files fall into batches, and whether any
    update was counted."""
    return _revised(spark, sf_dir).read("runs").select(
        "id",
        "status",
        "rows_fetched",
        "rows_inserted",
        (F.col("rows_updated") > 0).alias("any_updated"),
        "rows_rejected",
        "rows_flagged",
        "clean_pruned",
    )
