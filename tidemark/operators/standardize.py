"""Raw feed to typed, normalized records: two projections and one lookup join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import TEXT_LENGTHS, UPDATE_TIME_FIELDS
from tidemark.functions import numbers, text, times
from tidemark.operators.lookup import category_table


def update_time(feed: DataFrame) -> Column:
    """Update time of a record: the first of the known fields that holds a readable time."""
    present = [f for f in UPDATE_TIME_FIELDS if f in feed.columns]
    if not present:
        return F.lit(None).cast("timestamp")
    return F.coalesce(
        *[times.parse_update_time(text.strip(F.col(f"`{f}`").cast("string"))) for f in present]
    )


def standardize(
    feed: DataFrame, keep: tuple[str, ...] = (), lengths: dict[str, int] | None = None
) -> DataFrame:
    """One row in, one row out, whatever the row holds: unreadable values become NULL.

    The untouched text stays next to the cleaned value (``*_raw``) where a rule needs to tell
    "empty" from "malformed". ``keep`` names extra feed columns to carry through.

    Texts stay whole. ``lengths`` cuts the named text columns to so many characters, for a target
    with fixed widths; ``fixed_values.TEXT_LENGTHS`` has a set of them.

    The work is split in two projections so that text tidied once is used many times: Spark does
    not merge projections when that would repeat a costly expression.
    """

    def raw(name: str) -> Column:
        return F.col(name).cast("string") if name in feed.columns else F.lit(None).cast("string")

    # An empty address falls back to the street name, as a missing one does.
    address = F.coalesce(F.nullif(raw("incident_address"), F.lit("")), raw("street_name"))
    kept = [F.col(f"`{k}`") for k in keep]
    tidied = feed.select(
        raw("unique_key").alias("unique_key"),
        *[text.strip(raw(c)).alias(c) for c in ("created_date", "closed_date", "latitude", "longitude")],
        *[
            text.collapse_spaces(address if c == "incident_address" else raw(c)).alias(c)
            for c in (*TEXT_LENGTHS, "borough")
        ],
        raw("complaint_type").alias("complaint_type_raw"),
        raw("borough").alias("borough_raw"),
        raw("incident_zip").alias("incident_zip_raw"),
        text.zip_digits(raw("incident_zip")).alias("incident_zip"),
        text.address_key(address).alias("address_norm"),
        update_time(feed).alias("source_updated_at"),
        *kept,
    )
    typed = tidied.select(
        F.nullif("unique_key", F.lit("")).alias("unique_key"),
        *[times.parse_time(F.col(c)).alias(c) for c in ("created_date", "closed_date")],
        *[text.cut(F.col(c), (lengths or {}).get(c)).alias(c) for c in TEXT_LENGTHS],
        F.nullif(text.category_key(F.col("complaint_type")), F.lit("")).alias("category_key"),
        text.borough_name(F.col("borough")).alias("borough"),
        text.zip5(F.col("incident_zip")).alias("incident_zip"),
        F.nullif("address_norm", F.lit("")).alias("address_norm"),
        *[numbers.parse_number(F.col(c)).alias(c) for c in ("latitude", "longitude")],
        "complaint_type_raw",
        "borough_raw",
        "incident_zip_raw",
        "source_updated_at",
        *kept,
    )
    return canonicalize_category(typed)


def canonicalize_category(df: DataFrame) -> DataFrame:
    """``category_key`` to ``complaint_type_norm`` and ``known_category``.

    Unknown categories pass through in their upper-case form.
    """
    known = F.broadcast(category_table(df.sparkSession))
    joined = df.join(known, "category_key", "left")
    return joined.withColumns(
        {
            "complaint_type_norm": F.coalesce("canonical_category", "category_key"),
            "known_category": F.col("canonical_category").isNotNull(),
        }
    ).drop("category_key", "canonical_category")
