"""A record feed derived row by row from the ``events`` table, for the driver's queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import new_run_dir, timestamp_literal
from tidemark.operators.duplicates import mark_duplicates
from tidemark.operators.rollup import rollup
from tidemark.operators.standardize import standardize
from tidemark.operators.validate import accepted, validate
from tidemark.schema import CLEAN_FIELDS
from tidemark.sources.feed import ARRIVED

AS_OF_TIME = datetime(2024, 2, 1)
DEDUP_MINUTES = 60


def as_of() -> Column:
    return timestamp_literal(AS_OF_TIME)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A delivered table; zone-less timestamps are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def derived_feed(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Feed records as text, with ``event_id`` and ``ts`` of the event they stand for; the events dealt out,
    in their order, to ``parts`` partitions, or left as they are read."""
    events = read(spark, sf_dir, "events")
    if parts:
        events = events.repartitionByRange(parts, "event_id")
    events = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    key, k, u, ts = F.col("event_id"), F.col("k"), F.col("user_id"), F.col("ts")
    kind, even, slot = F.col("event_type"), F.col("k") % 2 == 0, F.col("user_id") % 6
    seconds = F.floor(F.col("value") * 3600 + 0.5)
    return events.select(
        "event_id",
        "ts",
        F.when(key % 499 != 0, key.cast("string")).alias("unique_key"),
        F.when(kind == "click", F.when(even, "Noise - Residential").otherwise("noise  residential"))
        .when(kind == "view", F.when(even, "Heating").otherwise("HEAT/HOT WATER"))
        .when(kind == "error", "Abandoned Vehicle")
        .when(kind == "purchase", F.when(k % 20 != 0, "Street Condition"))
        .when(kind == "signup", "Brand New Category")
        .alias("complaint_type"),
        _iso(
            F.when(key % 487 == 0, None)
            .when(key % 491 == 0, ts + F.expr("INTERVAL 60 DAYS"))
            .otherwise(ts)
        ).alias("created_date"),
        _iso(
            F.when(k % 3 == 0, None)
            .when(k % 11 == 1, ts - F.expr("INTERVAL 2 HOURS"))
            .when(k % 11 == 2, ts - F.expr("INTERVAL 30 SECONDS"))
            .otherwise(F.timestamp_micros(F.unix_micros(ts) + seconds * 1_000_000))
        ).alias("closed_date"),
        F.when(k % 3 == 0, "Open").otherwise("Closed").alias("status"),
        _pick(slot, ["MANHATTAN", "The Bronx", "Kings", "Queens", "Staten Is", "Unspecified"]).alias(
            "borough"
        ),
        F.when(k == 7, "N/A")
        .when(k == 8, "")
        .when(k == 9, "11215")
        .when(k == 10, "10463")
        .otherwise(_pick(slot, ["10011", "10457", "11215-3401", " 11375 ", "10314", "07030"]))
        .alias("incident_zip"),
        F.when(even, F.format_string("%d East %dth Street", u % 40 + 1, u % 9 + 4))
        .otherwise(F.format_string("%d E. %d ST", u % 40 + 1, u % 9 + 4))
        .alias("incident_address"),
        F.when(k == 20, None)
        .when(k == 22, "0")
        .when(k == 23, "-73.9")
        .when(k == 24, "34.05")
        .when(k == 25, "N/A")
        .otherwise("40.7")
        .alias("latitude"),
        F.when(k.isin(20, 21), None)
        .when(k == 22, "0")
        .when(k == 23, "40.7")
        .when(k == 24, "-118.24")
        .otherwise("-73.9")
        .alias("longitude"),
        (F.floor(F.unix_micros(ts) / 1_000_000) + 60 * k).cast("string").alias("updated_at"),
    )


# Tables Spark derived from the delivered ones, written once per session and read many times, as
# an ingest run persists a batch once for all of its sinks.
_written: dict[tuple, str] = {}


def _staged(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], by: tuple[str, ...] = ()
) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = new_run_dir(spark, name)
        rows = build().hint("rebalance", *by) if by else build()
        rows.write.partitionBy(*by).parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def once(spark: SparkSession, sf_dir: str, name: str, fill: Callable[[str], None]) -> str:
    """A folder that ``fill`` has filled, once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = new_run_dir(spark, name)
        fill(path)
        _written[key] = path
    return _written[key]


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived feed as a landing table, all text, by day of arrival."""

    def build() -> DataFrame:
        day = F.to_date(F.timestamp_seconds(F.col("updated_at").cast("bigint")))
        return derived_feed(spark, sf_dir).withColumn(ARRIVED, day)

    return _staged(spark, sf_dir, "feed", build, (ARRIVED,))


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole landing table."""
    return arrivals(spark, sf_dir).drop(ARRIVED)


def validated_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch straight from the events: dealt out while they are narrow, and no landing table is written for it."""
    fed = derived_feed(spark, sf_dir, 2 * spark.sparkContext.defaultParallelism)
    return validate(standardize(fed, keep=("event_id", "ts")), as_of())


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standardized and validated batch."""
    return _staged(spark, sf_dir, "batch", lambda: validated_now(spark, sf_dir))


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serving table: accepted records with their duplicate links."""

    def build() -> DataFrame:
        rows = accepted(validated(spark, sf_dir)).where(F.col("unique_key").isNotNull())
        return mark_duplicates(rows.select(*CLEAN_FIELDS, "event_id", "ts"), DEDUP_MINUTES)

    return _staged(spark, sf_dir, "clean", build)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily table rolled up from the serving table."""
    return _staged(spark, sf_dir, "daily", lambda: rollup(served(spark, sf_dir)))
