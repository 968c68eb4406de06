"""Duplicate submissions: chained gap clustering that never sorts a whole group.

Records of one group (category and address) belong to one cluster while each follows the one
before by at most the window. Time is cut into buckets one window wide: two records in the same
bucket are closer than the window, so a bucket lies in one cluster and only its first record,
last time and size matter. These come from an aggregate with map-side combining. Chaining then
runs over buckets, whose number per group is bounded by the time span and not by the records, and
the records look their survivor up by (group, bucket).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ("complaint_type_norm", "address_norm")


def _takes_part(group: tuple[str, ...], time: str, key: str) -> Column:
    """Group and key present and not empty, time present."""
    named = [F.length(F.col(c).cast("string")) > 0 for c in (*group, key)]
    return F.coalesce(reduce(and_, named), F.lit(False)) & F.col(time).isNotNull()


def _bucket(us: Column, width_us: int) -> Column:
    """Start of the bucket a time falls into; a zero width gives one bucket per instant."""
    return us - F.pmod(us, F.lit(width_us).cast("bigint")) if width_us else us


def _bucket_summary(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.groupBy(*names, "_b").agg(
        F.min(F.struct(F.col("_us").alias("us"), F.col("_key").alias("key"))).alias("head"),
        F.max("_us").alias("tail_us"),
        F.count(F.lit(1)).alias("n"),
    )


def _chain(summary: DataFrame, names: list[str], window_us: Column) -> DataFrame:
    """Adds ``starts`` and ``survivor`` (first record of the cluster) to the buckets."""
    in_order = Window.partitionBy(*names).orderBy("_b")
    gap = F.col("head.us") - F.lag("tail_us").over(in_order)
    starts = F.coalesce(gap > window_us, F.lit(True))
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return summary.withColumn("starts", starts).withColumn(
        "survivor", F.last(F.when(F.col("starts"), F.col("head")), ignorenulls=True).over(running)
    )


def mark_duplicates(
    records: DataFrame,
    window_minutes: int,
    group: tuple[str, ...] = GROUP,
    time: str = "created_date",
    key: str = "unique_key",
) -> DataFrame:
    """Adds ``is_duplicate_of`` and ``minutes_apart``, both NULL for survivors and for records
    that cannot take part (no group, time or key).

    Records that take no part stay out of the join, so a feed full of them does not skew it.
    """
    window_us = int(window_minutes * 60_000_000)
    part = _takes_part(group, time, key)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    names = [f"_g{i}" for i in range(len(group))]
    members = records.where(part).select(
        *[F.col(c).alias(n) for n, c in zip(names, group)],
        _bucket(us, window_us).alias("_b"),
        us.alias("_us"),
        F.col(key).cast("string").alias("_key"),
    )
    chained = _chain(_bucket_summary(members, names), names, F.lit(window_us))
    # A bucket holding just the record that opens a cluster has nothing to link.
    linked = chained.where("n > 1 OR NOT starts").select(*names, "_b", "survivor")
    keyed = records.where(part).withColumns(
        {"_us": us, "_key": F.col(key).cast("string"), "_bucket": _bucket(us, window_us)}
    )
    same = [F.col(c) == F.col(n) for n, c in zip(names, group)]
    out = keyed.join(linked, reduce(and_, same, F.col("_bucket") == F.col("_b")), "left")
    is_link = F.struct(F.col("_us").alias("us"), F.col("_key").alias("key")) != F.col("survivor")
    apart = F.round((F.col("_us") - F.col("survivor.us")) / F.lit(60_000_000), 2)
    marked = out.withColumns(
        {
            "is_duplicate_of": F.when(is_link, F.col("survivor.key")),
            "minutes_apart": F.when(is_link, apart),
        }
    ).drop(*names, "_us", "_key", "_bucket", "_b", "survivor")
    aside = records.where(~part).withColumns(
        {
            "is_duplicate_of": F.lit(None).cast("string"),
            "minutes_apart": F.lit(None).cast("double"),
        }
    )
    return marked.unionByName(aside)


def link_duplicates(
    records: DataFrame,
    window_minutes: int,
    group: tuple[str, ...] = GROUP,
    time: str = "created_date",
    key: str = "unique_key",
) -> DataFrame:
    """unique_key, duplicate_of, minutes_apart: one row per record that has a survivor."""
    marked = mark_duplicates(records.select(*group, time, key), window_minutes, group, time, key)
    return marked.where(F.col("is_duplicate_of").isNotNull()).select(
        F.col(key).cast("string").alias("unique_key"),
        F.col("is_duplicate_of").alias("duplicate_of"),
        "minutes_apart",
    )


def apply_links(records: DataFrame, links: DataFrame, key: str = "unique_key") -> DataFrame:
    """Replaces ``is_duplicate_of`` from the links; records without a link get NULL."""
    found = links.select(F.col("unique_key").alias("_k"), F.col("duplicate_of").alias("_of"))
    return (
        records.drop("is_duplicate_of")
        .join(found, F.col(key).cast("string") == F.col("_k"), "left")
        .withColumnRenamed("_of", "is_duplicate_of")
        .drop("_k")
    )


def cluster_sizes(links: DataFrame) -> DataFrame:
    """How many records each survivor absorbed."""
    return links.groupBy("duplicate_of").agg(F.count(F.lit(1)).alias("absorbed"))


def candidates(
    records: DataFrame,
    as_of: Column,
    days: int,
    group: tuple[str, ...] = GROUP,
    time: str = "created_date",
) -> DataFrame:
    """Records of the last ``days`` days that have a group."""
    named = reduce(and_, [F.col(c).isNotNull() for c in group])
    return records.where(named & (F.col(time) >= as_of - F.make_dt_interval(F.lit(days))))


def sweep_windows(
    records: DataFrame,
    windows: list[int],
    group: tuple[str, ...] = GROUP,
    time: str = "created_date",
    key: str = "unique_key",
) -> DataFrame:
    """window_minutes, candidates, collapsed, collapsed_pct, largest_cluster for every window.

    The records are read and bucketed once, at the smallest window (its buckets are whole inside
    the clusters of every wider window); only the bucket summaries are repeated per window.
    """
    smallest = int(min(windows) * 60_000_000)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    names = [f"_g{i}" for i in range(len(group))]
    rows = records.where(_takes_part(group, time, key)).select(
        *[F.col(c).alias(n) for n, c in zip(names, group)],
        us.alias("_us"),
        _bucket(us, smallest).alias("_bucket"),
    )
    summary = rows.groupBy(*names, "_bucket").agg(
        F.min("_us").alias("head_us"), F.max("_us").alias("tail_us"), F.count(F.lit(1)).alias("n")
    )
    per_window = summary.withColumn(
        "window_minutes", F.explode(F.array(*[F.lit(int(w)) for w in windows]))
    )
    in_order = Window.partitionBy("window_minutes", *names).orderBy("_bucket")
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col("head_us") - F.lag("tail_us").over(in_order)
    limit = F.col("window_minutes").cast("bigint") * 60_000_000
    clusters = (
        per_window.withColumn("_opens", F.coalesce((gap > limit), F.lit(True)).cast("int"))
        .withColumn("_cluster", F.sum("_opens").over(running))
        .groupBy("window_minutes", *names, "_cluster")
        .agg(F.sum("n").alias("members"))
    )
    tallies = clusters.groupBy("window_minutes").agg(
        F.sum("members").alias("candidates"),
        F.sum(F.col("members") - 1).alias("collapsed"),
        F.max("members").alias("top"),
    )
    # A window without candidates still reports a row.
    frame = records.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(int(w)) for w in windows])).alias("window_minutes")
    )
    zero = F.lit(0).cast("bigint")
    return frame.join(tallies, "window_minutes", "left").select(
        "window_minutes",
        F.coalesce("candidates", zero).alias("candidates"),
        F.coalesce("collapsed", zero).alias("collapsed"),
        F.coalesce(
            F.round(F.lit(100.0) * F.col("collapsed") / F.col("candidates"), 2), F.lit(0.0)
        ).alias("collapsed_pct"),
        F.when(F.col("top") > 1, F.col("top")).otherwise(zero).alias("largest_cluster"),
    )


def neighbours(
    stored: DataFrame,
    touched: DataFrame,
    window_minutes: int,
    group: tuple[str, ...] = GROUP,
    time: str = "created_date",
) -> DataFrame:
    """Stored records of the same group within twice the window of any touched record.

    The band is decided without forming pairs. With buckets as wide as the band, a touched record
    in the same bucket always matches, and of the two adjacent buckets only the latest time
    before and the earliest time after matter. So each stored record meets one summary row.
    """
    band = int(2 * window_minutes * 60_000_000)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    names = [f"_g{i}" for i in range(len(group))]
    seen = (
        touched.where(reduce(and_, [F.col(c).isNotNull() for c in (*group, time)]))
        .select(*[F.col(c).alias(n) for n, c in zip(names, group)], us.alias("_us"))
        .withColumn("_b", _bucket(F.col("_us"), band))
        .groupBy(*names, "_b")
        .agg(F.min("_us").alias("lo"), F.max("_us").alias("hi"))
    )
    nothing = F.lit(None).cast("bigint")

    def reach(shift: int, before: Column, inside: Column, after: Column) -> Column:
        return F.struct(
            (F.col("_b") + shift).alias("_bucket"),
            before.alias("before"),
            inside.alias("inside"),
            after.alias("after"),
        )

    lo, hi = F.col("lo"), F.col("hi")
    spread = seen.select(
        *names,
        F.inline(
            F.array(
                reach(-band, nothing, F.lit(False), lo),
                reach(0, nothing, F.lit(True), nothing),
                reach(band, hi, F.lit(False), nothing),
            )
        ),
    )
    summary = spread.groupBy(*names, "_bucket").agg(
        F.max("before").alias("before"), F.bool_or("inside").alias("inside"), F.min("after").alias("after")
    )
    keyed = stored.withColumns(
        {n: F.col(c) for n, c in zip(names, group)} | {"_us": us, "_bucket": _bucket(us, band)}
    )
    near = (
        F.col("inside")
        | F.coalesce(F.col("_us") - F.col("before") <= band, F.lit(False))
        | F.coalesce(F.col("after") - F.col("_us") <= band, F.lit(False))
    )
    return (
        keyed.join(summary, [*names, "_bucket"])
        .where(near)
        .drop(*names, "_us", "_bucket", "before", "inside", "after")
    )


def touched_groups(touched: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Distinct groups of the touched records, for recomputing whole groups."""
    named = reduce(and_, [F.col(c).isNotNull() for c in group])
    return touched.where(named).select(*group).distinct()
