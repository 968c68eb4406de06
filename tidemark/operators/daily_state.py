"""The daily rollup as state that is added to, so that a batch updates days without reading their rows.

For each day, borough and category the state holds how many records had each number of microseconds
to their close, and the counts of the daily table. All of it is sums, so what a batch changed
is the state of its records as they are now, less that of the same records as they were. Such
differences are appended by day; the figures of a day, the exact median included, follow from the
sums of its rows. Deletions are differences too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.median import exact_median
from tidemark.operators.rollup import KEYS, measured, with_medians

COUNTS = ("request_count", "closed_count", "defect_count", "duplicate_count")
#: ``n`` counts the records with the given ``open_us``; it is 0 where that is NULL.
COLUMNS = (*KEYS, "open_us", *COUNTS, "n")


def _summed(rows: DataFrame) -> DataFrame:
    sums = [F.sum(c).cast("bigint").alias(c) for c in (*COUNTS, "n")]
    held = " OR ".join(f"{c} <> 0" for c in (*COUNTS, "n"))
    # Spread by the value as well, so a crowded day and category doesn't meet in one task.
    return rows.groupBy(*KEYS, "open_us").agg(*sums).where(held)


def state(clean: DataFrame, sign: int = 1) -> DataFrame:
    """The state of served records; with ``sign`` -1 what taking them away comes to."""
    flag = lambda c: F.col(c).cast("bigint") * sign
    return _summed(
        measured(clean).select(
            *KEYS,
            "open_us",
            flag("survivor").alias("request_count"),
            flag("closed").alias("closed_count"),
            flag("defective").alias("defect_count"),
            (F.lit(sign) - flag("survivor")).alias("duplicate_count"),
            (F.col("open_us").isNotNull().cast("bigint") * sign).alias("n"),
        )
    )


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a batch adds to the state: ``before`` and ``after`` are the served records it inserted,
    changed, linked anew or deleted, as they were and as they are."""
    return _summed(state(after).unionByName(state(before, -1)))


def added(*states: DataFrame) -> DataFrame:
    """The sum of states and differences; what comes to nothing is left out."""
    return _summed(reduce(DataFrame.unionByName, states))


def daily(*states: DataFrame) -> DataFrame:
    """The daily table, as :func:`tidemark.operators.rollup.rollup` of the records gives it."""
    rows = reduce(DataFrame.unionByName, states)
    sums = [F.sum(c).cast("bigint").alias(c) for c in COUNTS]
    counts = rows.groupBy(*KEYS).agg(*sums).where("request_count <> 0 OR duplicate_count <> 0")
    return with_medians(counts, exact_median(rows, KEYS, "open_us", weight="n"))
