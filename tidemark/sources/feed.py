"""The change feed: a landing folder of JSON records, read in batch or as a stream.

Where the landing folder has a sub-folder ``arrived_on=YYYY-MM-DD`` for each day of arrival, a
scan from a watermark lists and reads the days from the watermark's on. A record can't arrive
before it was updated; one day of slack covers clocks that differ.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.standardize import update_time
from tidemark.schema import FEED_SCHEMA

_OBJECTS = "array<string>"

#: Partition column of a landing folder: the day a record arrived.
ARRIVED = "arrived_on"
_SLACK_DAYS = 1


def parse_payloads(lines: DataFrame, payload: str = "value") -> DataFrame:
    """JSON text to feed columns, all text and NULL where absent; the text stays as ``payload``.

    Only the named fields are parsed out. Text that is not JSON gives a record without a key.
    """
    return lines.select(
        F.col(payload).alias("payload"), F.from_json(payload, FEED_SCHEMA).alias("r")
    ).select("payload", "r.*")


def _objects(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode(F.from_json("value", _OBJECTS)).alias("value"))


def first_arrival(watermark: datetime) -> str:
    """The first day of arrival that may hold records updated at or after the watermark."""
    return (watermark - timedelta(days=_SLACK_DAYS)).strftime("%Y-%m-%d")


def _parsed(lines: DataFrame, layout: str, arrived_from: str | None) -> DataFrame:
    if arrived_from and ARRIVED in lines.columns:
        lines = lines.where(F.col(ARRIVED) >= F.lit(arrived_from).cast("date"))
    return parse_payloads(_objects(lines) if layout == "pages" else lines)


def read_feed(
    spark: SparkSession,
    path: str | list[str],
    layout: str = "lines",
    arrived_from: str | None = None,
) -> DataFrame:
    """``layout`` is ``lines`` (one object per line) or ``pages`` (one JSON array per file, which
    one task reads whole: for pages as an HTTP service gives them, not for large files).
    ``arrived_from`` leaves out earlier days of arrival, if the folder is laid out by them."""
    return _parsed(spark.read.text(path, wholetext=layout == "pages"), layout, arrived_from)


def stream_feed(
    spark: SparkSession,
    path: str,
    layout: str = "lines",
    max_files: int = 6,
    arrived_from: str | None = None,
) -> DataFrame:
    """The landing folder as a stream, at most ``max_files`` new files per micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    return _parsed(reader.text(path, wholetext=layout == "pages"), layout, arrived_from)


def since(feed: DataFrame, watermark: Column) -> DataFrame:
    """Records updated at or after the watermark, with ``source_updated_at``.

    The bound is inclusive: records sharing the last update time may come twice, and the upsert
    makes that harmless, while an exclusive bound could lose some. Of a feed with days of arrival
    only those from the watermark's on are read.
    """
    if ARRIVED in feed.columns:
        feed = feed.where(F.col(ARRIVED) >= F.date_sub(watermark, _SLACK_DAYS)).drop(ARRIVED)
    return feed.withColumn("source_updated_at", update_time(feed)).where(
        F.col("source_updated_at") >= watermark
    )


def start_watermark(as_of: Column, days_back: int = 3) -> Column:
    """Where a store that never ingested anything begins."""
    return as_of - F.make_dt_interval(F.lit(days_back))


def next_watermark(max_updated: Column) -> Column:
    return max_updated + F.expr("INTERVAL 1 MILLISECOND")


def field_profile(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """field, rows_present, rows_filled, fill_pct for every field that occurs in the feed.

    Fields are found in the data and not in the schema, so renamed or new ones show up.
    """
    fields = payloads.select(
        F.explode(F.from_json(payload, "map<string,string>")).alias("field", "value")
    )
    filled = F.count_if(F.coalesce(F.col("value"), F.lit("")) != "")
    present = F.count(F.lit(1))
    return fields.groupBy("field").agg(
        present.alias("rows_present"),
        filled.alias("rows_filled"),
        F.round(F.lit(100.0) * filled / present, 2).alias("fill_pct"),
    )


def feed_profile(feed: DataFrame) -> DataFrame:
    """One row: rows, whether any update time is readable, the newest one, and that record."""
    updated = update_time(feed)
    return feed.agg(
        F.count(F.lit(1)).alias("rows_returned"),
        F.coalesce(F.bool_or(updated.isNotNull()), F.lit(False)).alias("has_updated_at"),
        F.max(updated).alias("newest_updated_at"),
        F.max_by("payload", updated).alias("sample"),
    )
