"""Clusters of the records a batch touched, walked outward over time instead of read as whole groups.

Time is cut into buckets one window wide, as in :mod:`tidemark.operators.duplicates`. A record can only
be linked with records of its own bucket and of the two next to it, so a change in a bucket reaches
as far as neighbouring buckets follow each other by at most the window. The walk asks for the
buckets about those that gained or lost a record, then for those beyond the ends still linked, in
strides that double, until a gap ends every chain. Each round reads the days its buckets lie in and
nothing else of a group, however long its history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.duplicates import GROUP, _bucket, _bucket_summary, _takes_part, mark_duplicates
from tidemark.sources.staging import written

#: Reads the records of some days (yyyy-MM-dd, UTC) as they stand after the batch.
ReadDays = Callable[[list[str]], DataFrame]

#: Buckets asked for on each side in the first round; twice as many in each that follows.
FIRST_REACH = 2


def _names(group: tuple[str, ...]) -> list[str]:
    return [f"_g{i}" for i in range(len(group))]


def _placed(
    rows: DataFrame, width: int, group: tuple[str, ...], time: str, key: str | None = None
) -> DataFrame:
    """The rows that can take part, with group (``_g0``, ...), bucket, time and key. Without a key every
    row with a group and a time counts, as a place may have lost its record."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    added = {n: F.col(c) for n, c in zip(_names(group), group)} | {"_b": _bucket(us, width), "_us": us}
    if key:
        added["_key"] = F.col(key).cast("string")
    return rows.where(_takes_part(group, time, key or group[0])).withColumns(added)


def _days(buckets: DataFrame, width: int) -> list[str]:
    """Days that buckets lie in; as many as the calendar has, whatever the rows."""
    day = lambda us: F.to_date(F.timestamp_micros(us))
    spans = buckets.select(day(F.col("_b")).alias("a"), day(F.col("_b") + (width - 1)).alias("z")).distinct()
    each = spans.select(F.explode(F.sequence("a", "z")).alias("day")).distinct()
    return sorted(str(r.day) for r in each.collect())


def _reached(known: DataFrame, names: list[str], width: int) -> DataFrame:
    """Adds ``right`` and ``left``: whether a walk from a seed comes to the bucket in that direction;
    and ``last`` and ``first``: whether nothing was asked beyond it.

    From a seed the walk always goes on to the next bucket, if that isn't empty: the two may have
    been linked before the batch. Beyond, it goes on while buckets are linked.
    """
    out = known
    for side, step, order in (("right", width, F.col("_b").asc()), ("left", -width, F.col("_b").desc())):
        w = Window.partitionBy(*names).orderBy(order)
        before = {c: F.lag(c).over(w) for c in ("_b", "seed", "tail_us", "n")}
        if side == "right":
            gap = F.col("head.us") - before["tail_us"]
        else:
            gap = F.lag(F.col("head.us")).over(w) - F.col("tail_us")
        follows = (before["_b"] + step == F.col("_b")) & F.col("n").isNotNull()
        goes_on = follows & (before["seed"] | (before["n"].isNotNull() & (gap <= width)))
        stops = ~F.col("seed") & ~F.coalesce(goes_on, F.lit(False))
        # The place of the last seed against that of the last stop, both counted along the walk.
        place = F.row_number().over(w)
        out = out.withColumns({"_place": place, "_stops": stops})
        running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seed = F.max(F.when(F.col("seed"), F.col("_place"))).over(running)
        stop = F.max(F.when(F.col("_stops"), F.col("_place"))).over(running)
        last = F.coalesce(F.lead("_b").over(w) != F.col("_b") + step, F.lit(True))
        out = out.withColumns(
            {
                side: F.coalesce(seed > F.coalesce(stop, F.lit(0)), F.lit(False)),
                "last" if side == "right" else "first": last,
            }
        ).drop("_place", "_stops")
    return out


def affected_records(
    read: ReadDays,
    touched: DataFrame,
    window_minutes: int,
    group: tuple[str, ...] = GROUP,
    time: str = "created_date",
    key: str = "unique_key",
) -> DataFrame:
    """The records, as ``read`` gives them, whose links may be others than before: whole clusters, with
    all records in the buckets that hold a place of ``touched``.

    ``touched`` has the group and time of each record the batch added or changed, as they are now
    and as they were before. Rows without a group or time touch nothing.
    """
    names, width = _names(group), int(window_minutes * 60_000_000)
    bucket = [*names, "_b"]
    seeds = _placed(touched, width, group, time).select(*bucket)

    def beyond(rows: DataFrame, steps: list[int]) -> DataFrame:
        shifts = F.explode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("_s")
        return rows.select(*bucket, shifts).select(
            *names, (F.col("_b") + F.col("_s") * width).alias("_b"), (F.col("_s") == 0).alias("seed")
        )

    reach = FIRST_REACH
    first = beyond(seeds.distinct(), list(range(-reach, reach + 1))).groupBy(*bucket).agg(F.bool_or("seed").alias("seed"))
    # Written, as its days, its records and its buckets are each looked up, and ``touched`` may cost a join of all rows.
    asked = written(first, "asked")
    known = records = None
    while True:
        rows = _placed(read(_days(asked, width)), width, group, time, key)
        found = written(rows.join(asked.select(*bucket), bucket, "left_semi"), "members")
        told = asked.join(_bucket_summary(found, names), bucket, "left")
        known = known.unionByName(told) if known else told
        records = records.unionByName(found) if records else found
        reached = written(_reached(known, names, width), "reached")
        known = reached.select(*known.columns)
        reach *= 2
        forth = beyond(reached.where("right AND last"), list(range(1, reach + 1)))
        back = beyond(reached.where("left AND first"), list(range(-reach, 0)))
        new = forth.unionByName(back).distinct().join(known.select(*bucket), bucket, "left_anti")
        asked = written(new, "asked")
        if asked.isEmpty():
            region = reached.where("(right OR left) AND n IS NOT NULL").select(*bucket)
            return records.join(region, bucket, "left_semi").drop(*bucket, "_us", "_key")


def relink(
    read: ReadDays,
    touched: DataFrame,
    window_minutes: int,
    group: tuple[str, ...] = GROUP,
    time: str = "created_date",
    key: str = "unique_key",
) -> DataFrame:
    """The records of all clusters that ``touched`` may have changed, as ``read`` gives them, with
    ``is_duplicate_of`` and ``minutes_apart`` anew. All other records keep the links they have.

    ``window_minutes`` must be above 0. A touched record that can't take part any more isn't among the
    rows; it has no link.
    """
    members = affected_records(read, touched, window_minutes, group, time, key)
    return mark_duplicates(members, window_minutes, group, time, key)
