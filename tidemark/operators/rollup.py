"""Daily rollup by day, borough and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import micros_between
from tidemark.operators.median import exact_median

KEYS = ["day", "borough", "complaint_type_norm"]
_HOUR_US = 3_600_000_000.0


def measured(clean: DataFrame) -> DataFrame:
    """What the rollup counts of each dated record: its keys, four flags, and ``open_us``, the
    microseconds to its close, NULL where they stay out of the median."""
    survivor = F.col("is_duplicate_of").isNull()
    closed = F.col("closed_date").isNotNull()
    return clean.where(F.col("created_date").isNotNull()).select(
        F.to_date("created_date").alias("day"),
        F.coalesce("borough", F.lit("UNSPECIFIED")).alias("borough"),
        F.coalesce("complaint_type_norm", F.lit("UNKNOWN")).alias("complaint_type_norm"),
        survivor.alias("survivor"),
        (survivor & closed).alias("closed"),
        (survivor & (F.col("defect_count") > 0)).alias("defective"),
        F.when(
            survivor & (F.col("closed_date") >= F.col("created_date")),
            micros_between(F.col("closed_date"), F.col("created_date")),
        ).alias("open_us"),
    )


def with_medians(counts: DataFrame, medians: DataFrame) -> DataFrame:
    """The columns of the daily table from the counts and the medians of ``open_us`` by KEYS."""
    return counts.join(medians, KEYS, "left").select(
        *KEYS,
        "request_count",
        "closed_count",
        (F.col("median") / F.lit(_HOUR_US)).alias("median_hours_to_close"),
        "defect_count",
        "duplicate_count",
    )


def rollup(clean: DataFrame) -> DataFrame:
    """Real problems, closed ones, median hours to close, defective ones and duplicates.

    Duplicates count only as duplicates. A record closed before it was created counts as closed
    but stays out of the median.
    """
    rows = measured(clean)
    counts = rows.groupBy(*KEYS).agg(
        F.count_if("survivor").alias("request_count"),
        F.count_if("closed").alias("closed_count"),
        F.count_if("defective").alias("defect_count"),
        F.count_if(~F.col("survivor")).alias("duplicate_count"),
    )
    return with_medians(counts, exact_median(rows, KEYS, "open_us"))


def days_of_keys(clean: DataFrame, touched: DataFrame, key: str = "unique_key") -> DataFrame:
    """Distinct created days of the touched records."""
    keys = touched.select(key)
    return (
        clean.where(F.col("created_date").isNotNull())
        .select(key, F.to_date("created_date").alias("day"))
        .join(keys, key, "left_semi")
        .select("day")
        .distinct()
    )


def days_since(clean: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Distinct created days of the last ``days`` days."""
    first = F.date_sub(F.to_date(as_of), days)
    return (
        clean.where(F.col("created_date") >= first)
        .select(F.to_date("created_date").alias("day"))
        .distinct()
    )


def rollup_days(clean: DataFrame, days: DataFrame) -> DataFrame:
    """The rollup of the given days only."""
    rows = clean.withColumn("day", F.to_date("created_date"))
    return rollup(rows.join(days.select("day"), "day", "left_semi").drop("day"))


def replace_days(daily: DataFrame, fresh: DataFrame, days: DataFrame) -> DataFrame:
    """``daily`` with the given days taken whole from ``fresh``: groups that vanished go too."""
    kept = daily.join(days.select("day"), "day", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
