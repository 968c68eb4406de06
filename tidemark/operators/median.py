"""Exact median per group without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Values are first counted per bin of this width; microseconds, so one minute.
BIN_WIDTH = 60_000_000


def exact_median(
    df: DataFrame, keys: list[str], value: str, bin_width: int = BIN_WIDTH, weight: str | None = None
) -> DataFrame:
    """keys, ``median``: the interpolated median of an integer column, NULLs ignored. With ``weight``, a
    column of whole numbers, a row stands for so many; sums of weights that are 0 count for nothing.

    Counts per distinct value are combined map-side and spread by (keys, value). A second count
    per bin finds the one or two bins that hold the middle ranks, and only the values of those
    bins are ordered. The rows of a group therefore never meet in one place; what does is its
    bins, whose number follows the value range and not the number of rows. Keys must not be NULL.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
        .where("_n > 0")
        .withColumn("_bin", F.col("_v") - F.pmod("_v", F.lit(bin_width).cast("bigint")))
        # Said here so that both uses below ask for the same rows and share one shuffle.
        .where(F.col("_bin").isNotNull())
    )
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    total = F.sum("_n").over(Window.partitionBy(*keys))
    bins = (
        counted.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(by_bin.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", total)
        .withColumn("_low", F.floor((F.col("_total") - 1) / 2))
        .withColumn("_high", F.floor(F.col("_total") / 2))
        .where("_upto > _low AND _upto - _n <= _high")
        .select(*keys, "_bin", (F.col("_upto") - F.col("_n")).alias("_before"), "_low", "_high")
    )
    within = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    middle = (
        counted.join(bins, [*keys, "_bin"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(within))
        .where("_upto > _low AND _upto - _n <= _high")
    )
    return middle.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / F.lit(2.0)).alias("median"))
