"""Read queries over the stored tables. Each takes and gives DataFrames."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.config import timestamp_literal
from tidemark.operators.lookup import rule_table

PAGE_COLUMNS = (
    "unique_key",
    "created_date",
    "closed_date",
    "agency",
    "complaint_type",
    "complaint_type_norm",
    "descriptor",
    "status",
    "borough",
    "incident_zip",
    "incident_address",
    "latitude",
    "longitude",
    "defect_count",
    "is_duplicate_of",
    "zip_borough_conflict",
    "unrecognized_type",
)

DAY_COUNTERS = (
    "rows_fetched",
    "rows_inserted",
    "rows_updated",
    "rows_rejected",
    "rows_flagged",
    "duplicates_collapsed",
)

DELTA_COUNTERS = ("rows_fetched", "rows_flagged", "rows_rejected", "duplicates_collapsed")


# ---- records -------------------------------------------------------------------------------


def request_filter(
    borough: str | None = None,
    complaint_type: str | None = None,
    status: str | None = None,
    defects_only: bool = False,
    include_duplicates: bool = False,
    since: date | str | None = None,
) -> Column:
    """Conjunction of the conditions that were asked for. Duplicates are hidden by default.

    ``status`` matches without case; ``%`` and ``_`` in it are wildcards.
    """
    wanted = [F.lit(True)]
    if not include_duplicates:
        wanted.append(F.col("is_duplicate_of").isNull())
    if borough:
        wanted.append(F.col("borough") == borough.upper())
    if complaint_type:
        wanted.append(F.col("complaint_type_norm") == complaint_type.upper())
    if status:
        wanted.append(F.col("status").ilike(status))
    if defects_only:
        wanted.append(F.col("defect_count") > 0)
    if since:
        wanted.append(F.col("created_date") >= F.lit(str(since)).cast("date"))
    return reduce(and_, wanted)


def requests_page(
    clean: DataFrame, condition: Column, limit: int = 200, offset: int = 0
) -> DataFrame:
    """One page, newest first, undated records last; the key settles ties."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset not negative")
    return (
        clean.where(condition)
        .select(*[c for c in PAGE_COLUMNS if c in clean.columns])
        .orderBy(F.desc_nulls_last("created_date"), "unique_key")
        .offset(offset)
        .limit(limit)
    )


def requests_after(
    clean: DataFrame, condition: Column, last: tuple[datetime | None, str] | None = None, limit: int = 200
) -> DataFrame:
    """The page that follows the record with created date and key ``last`` (None: the first page), in the
    order of :func:`requests_page`.

    The place is part of the filter, so it reaches the scan, and every page is a top-k of its own
    size however deep it lies: each task keeps ``limit`` rows and nothing is counted off.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    beyond = F.lit(True)
    if last:
        created, key = last
        at, later_key = F.col("created_date"), F.col("unique_key") > F.lit(key)
        if created is None:
            beyond = at.isNull() & later_key
        else:
            moment = timestamp_literal(created)
            beyond = (at < moment) | ((at == moment) & later_key) | at.isNull()
    return requests_page(clean, condition & beyond, limit)


def requests_total(clean: DataFrame, condition: Column) -> DataFrame:
    return clean.where(condition).agg(F.count(F.lit(1)).alias("total"))


def request_detail(
    clean: DataFrame, failures: DataFrame, key: str
) -> dict[str, DataFrame]:
    """The record, its failures (newest first) and the records collapsed into it.

    Three DataFrames, because a survivor may have absorbed any number of records.
    """
    return {
        "request": clean.where(F.col("unique_key") == key),
        "validation_failures": failures.where(F.col("unique_key") == key)
        .select("rule", "severity", "detail", "field_value", "detected_at")
        .orderBy(F.desc("detected_at")),
        "collapsed_duplicates": clean.where(F.col("is_duplicate_of") == key).select(
            "unique_key", "created_date"
        ),
    }


def request_overview(clean: DataFrame, failures: DataFrame) -> DataFrame:
    """Every record with the number of its failures and of the records collapsed into it.

    Both sides are aggregated to one row per key before they are joined.
    """
    per_key = failures.groupBy("unique_key").agg(
        F.count(F.lit(1)).alias("failure_count"),
        F.min("rule").alias("first_rule"),
        F.max("rule").alias("last_rule"),
    )
    children = (
        clean.where(F.col("is_duplicate_of").isNotNull())
        .groupBy(F.col("is_duplicate_of").alias("unique_key"))
        .agg(
            F.count(F.lit(1)).alias("duplicate_count"),
            F.min("created_date").alias("first_duplicate_at"),
            F.max("created_date").alias("last_duplicate_at"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return (
        clean.join(per_key, "unique_key", "left")
        .join(children, "unique_key", "left")
        .withColumns(
            {
                "failure_count": F.coalesce("failure_count", zero),
                "duplicate_count": F.coalesce("duplicate_count", zero),
            }
        )
    )


def quality_labels() -> Column:
    """Short labels for what is wrong with a served record, in a fixed order."""
    defects = F.col("defect_count")
    named = F.array_compact(
        F.array(
            F.when(F.col("zip_borough_conflict"), F.lit("borough conflict")),
            F.when(F.col("unrecognized_type"), F.lit("new category")),
            F.when(F.col("is_duplicate_of").isNotNull(), F.lit("duplicate")),
        )
    )
    counted = F.concat(
        defects.cast("string"), F.when(defects > 1, F.lit(" defects")).otherwise(F.lit(" defect"))
    )
    return F.when((F.size(named) == 0) & (defects > 0), F.array(counted)).otherwise(named)


def top_categories(clean: DataFrame, limit: int = 40) -> DataFrame:
    """Most frequent categories among survivors; ties go by name."""
    return (
        clean.where(F.col("complaint_type_norm").isNotNull() & F.col("is_duplicate_of").isNull())
        .groupBy(F.col("complaint_type_norm").alias("complaint_type"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bool_or("unrecognized_type").alias("has_unrecognized"),
        )
        .orderBy(F.desc("n"), "complaint_type")
        .limit(limit)
    )


def borough_defects(clean: DataFrame) -> DataFrame:
    """Survivors, defective ones and their share in percent per borough."""
    defective = F.count_if(F.col("defect_count") > 0)
    total = F.count(F.lit(1))
    return (
        clean.where(F.col("is_duplicate_of").isNull())
        .groupBy(F.coalesce("borough", F.lit("UNSPECIFIED")).alias("borough"))
        .agg(
            total.alias("n"),
            defective.alias("with_defects"),
            F.round(F.lit(100.0) * defective / F.nullif(total, F.lit(0)), 2).alias(
                "defect_rate_pct"
            ),
        )
        .orderBy(F.desc("n"), "borough")
    )


# ---- daily table ---------------------------------------------------------------------------

_DIMENSIONS = {"day": "day", "borough": "borough", "complaint_type": "complaint_type_norm"}


def daily_by(
    daily: DataFrame,
    as_of: Column,
    days: int = 30,
    dimension: str = "day",
    borough: str | None = None,
    complaint_type: str | None = None,
) -> DataFrame:
    """The daily table of the last ``days`` days regrouped by one dimension.

    ``avg_median_hours_to_close`` is the plain mean of the group medians, not weighted.
    """
    wanted = [F.col("day") >= F.date_sub(F.to_date(as_of), days)]
    if borough:
        wanted.append(F.col("borough") == borough.upper())
    if complaint_type:
        wanted.append(F.col("complaint_type_norm") == complaint_type.upper())
    mean = F.avg("median_hours_to_close").cast("decimal(38,10)")
    return (
        daily.where(reduce(and_, wanted))
        .groupBy(F.col(_DIMENSIONS[dimension]).alias("key"))
        .agg(
            *[
                F.sum(c).alias(c)
                for c in ("request_count", "closed_count", "defect_count", "duplicate_count")
            ],
            F.round(mean, 1).alias("avg_median_hours_to_close"),
        )
        .orderBy("key")
    )


# ---- run log -------------------------------------------------------------------------------


def latest_run(runs: DataFrame, completed: bool = True) -> DataFrame:
    rows = runs.where("status <> 'running'") if completed else runs
    return rows.orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def recent_runs(runs: DataFrame, limit: int = 30) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def run_deltas(runs: DataFrame) -> DataFrame:
    """Completed runs with the change of four counters since the run before (NULL for the first).

    The run log has one row per run, so ordering all of it is cheap.
    """
    in_order = Window.orderBy("started_at", "id")

    def change(counter: str) -> Column:
        value = F.coalesce(F.col(counter), F.lit(0))
        return value - F.lag(value).over(in_order)

    return runs.where("status <> 'running'").withColumns(
        {f"{c}_change": change(c) for c in DELTA_COUNTERS}
    )


def last_day_totals(runs: DataFrame, as_of: Column) -> DataFrame:
    """Counters summed over completed runs started in the 24 hours before ``as_of``."""
    zero = F.lit(0).cast("bigint")
    return runs.where(
        (F.col("started_at") > as_of - F.expr("INTERVAL 24 HOURS")) & (F.col("status") != "running")
    ).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in DAY_COUNTERS],
        F.count(F.lit(1)).alias("runs"),
    )


def freshness(runs: DataFrame, as_of: Column, stale_after_minutes: int = 180) -> DataFrame:
    """Minutes since the last successful run ended, and whether that is too long ago."""
    last = F.max(F.when(F.col("status") == "success", F.col("finished_at")))
    minutes = (F.unix_micros(as_of) - F.unix_micros(last)) / F.lit(60_000_000)
    return runs.agg(minutes.alias("m")).select(
        F.round("m", 1).alias("minutes_since_last_success"),
        F.coalesce(F.col("m") > stale_after_minutes, F.lit(False)).alias("stale"),
    )


def health(runs: DataFrame, as_of: Column, stale_after_minutes: int = 180) -> DataFrame:
    """One row: flag and duplicate rate of the last 24 hours, freshness and overall state."""

    def rate(counter: str) -> Column:
        share = F.lit(100.0) * F.col(counter) / F.nullif(F.col("rows_fetched"), F.lit(0))
        return F.round(F.coalesce(share, F.lit(0.0)), 1)

    last = latest_run(runs).select(F.col("status").alias("last_status"))
    state = (
        F.when(F.col("last_status").isin("failed", "partial"), "critical")
        .when(F.col("stale"), "warning")
        .otherwise("good")
    )
    # All three inputs are single rows.
    return (
        last_day_totals(runs, as_of)
        .join(freshness(runs, as_of, stale_after_minutes), how="left")
        .join(last, how="left")
        .select(
            "rows_fetched",
            rate("rows_flagged").alias("flag_rate_pct"),
            rate("duplicates_collapsed").alias("duplicate_rate_pct"),
            "minutes_since_last_success",
            "stale",
            "last_status",
            state.alias("state"),
        )
    )


def status(runs: DataFrame, as_of: Column) -> DataFrame:
    """The latest run, finished or not, with the minutes since the last success."""
    return latest_run(runs, completed=False).join(
        freshness(runs, as_of).select("minutes_since_last_success"), how="left"
    )


# ---- quality -------------------------------------------------------------------------------


def rule_report(counts: DataFrame, fetched: Column) -> DataFrame:
    """Rules by number of failures with the rate in percent of the fetched rows."""
    rate = F.lit(100.0) * F.col("failures") / F.nullif(fetched, F.lit(0))
    return counts.select(
        "rule",
        "severity",
        "failures",
        F.round(F.coalesce(rate, F.lit(0.0)), 3).alias("rate_pct"),
        "ord",
    ).orderBy(F.desc("failures"), "ord")


def stored_rule_counts(failures: DataFrame) -> DataFrame:
    """Counts from the failure table for every registered rule, those without failures at zero,
    and for any other rule that failed, after them."""
    named = "severity" in failures.columns
    found = F.max("severity") if named else F.lit(None).cast("string")
    counted = failures.groupBy("rule").agg(F.count(F.lit(1)).alias("failures"), found.alias("found"))
    return (
        rule_table(failures.sparkSession)
        .join(counted, "rule", "full")
        .withColumn("failures", F.coalesce("failures", F.lit(0).cast("bigint")))
        .withColumn("severity", F.coalesce("severity", "found"))
        .withColumn("ord", F.coalesce("ord", F.lit(len(fixed.RULES))))
        .drop("found")
    )


def store_totals(clean: DataFrame, raw: DataFrame, daily: DataFrame) -> DataFrame:
    """Row totals of the stored tables; each table is read once."""
    counted = clean.agg(
        F.count(F.lit(1)).alias("clean_rows"),
        F.count_if(F.col("is_duplicate_of").isNotNull()).alias("duplicate_rows"),
        F.count_if(F.col("defect_count") > 0).alias("defective_rows"),
    )
    kept = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    rolled = daily.agg(F.count(F.lit(1)).alias("agg_rows"), F.min("day").alias("agg_since"))
    return counted.join(kept, how="left").join(rolled, how="left")


def quality_report(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    as_of: Column,
    dedup_window_minutes: int = 60,
    raw_days: int = 7,
    clean_days: int = 60,
) -> dict[str, DataFrame]:
    """Everything about the latest completed run: the run, its deltas, 24 h totals, rules, store."""
    runs = tables["runs"]
    latest = latest_run(runs)
    of_run = tables["failures"].join(
        latest.select(F.col("id").alias("ingest_run_id")), "ingest_run_id", "left_semi"
    )
    counts = stored_rule_counts(of_run).join(latest.select("rows_fetched"), how="left")
    return {
        "latest_run": latest,
        "change_since_previous_run": latest_run(run_deltas(runs)).select(
            *[f"{c}_change" for c in DELTA_COUNTERS]
        ),
        "last_24h": last_day_totals(runs, as_of),
        "rules": rule_report(counts, F.col("rows_fetched")).drop("ord"),
        "totals": store_totals(tables["clean"], tables["raw"], tables["daily"]),
        "settings": spark.range(1).select(
            F.lit(dedup_window_minutes).alias("dedup_window_minutes"),
            F.lit(raw_days).alias("raw_days"),
            F.lit(clean_days).alias("clean_days"),
            F.lit("permanent").alias("daily_agg"),
        ),
    }


def storage_report(tables: dict[str, DataFrame], budget_bytes: int) -> DataFrame:
    """Rows, files and bytes of file-backed tables with the share of the budget, largest first.

    Sizes come from file metadata; counting rows reads no column.
    """
    sizes = []
    for name, table in tables.items():
        per_file = (
            table.select("_metadata.file_path", "_metadata.file_size")
            .groupBy("file_path")
            .agg(F.max("file_size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        )
        sizes.append(
            per_file.agg(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
                F.count(F.lit(1)).alias("files"),
                F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"),
            ).select(F.lit(name).alias("table_name"), "*")
        )
    total = F.sum("size_bytes").over(Window.partitionBy())
    return (
        reduce(DataFrame.unionByName, sizes)
        .withColumns({"used_pct": F.round(F.lit(100.0) * total / budget_bytes, 2), "total_bytes": total})
        .orderBy(F.desc("size_bytes"), "table_name")
    )
