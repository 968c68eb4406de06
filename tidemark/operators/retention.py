"""Retention: what stays and what goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cutoff(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def keeps(time: str, as_of: Column, days: int) -> Column:
    """True for rows inside the window; rows without a time are kept."""
    return F.coalesce(F.col(time) >= cutoff(as_of, days), F.lit(True))


def prune(df: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    return df.where(keeps(time, as_of, days))


def prune_counts(df: DataFrame, time: str, as_of: Column, windows: dict[str, int]) -> DataFrame:
    """name, kept, pruned for several windows over one table, in one pass."""
    totals = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(keeps(time, as_of, d)).alias(name) for name, d in windows.items()],
    )
    rows = [
        F.struct(
            F.lit(name).alias("name"),
            F.col(name).alias("kept"),
            (F.col("total") - F.col(name)).alias("pruned"),
        )
        for name in windows
    ]
    return totals.select(F.inline(F.array(*rows)))
