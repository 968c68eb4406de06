"""What the operators of this package share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import new_run_dir

ARROW_ROWS = 256


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Arrow batches of few rows, so that a Python worker holds few whole texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Returns what a Python worker has freed to the system. An idle worker would otherwise keep its peak,
    beside the workers and the JVM of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the folder all executors share, and read back: it is made
    once, and a lost executor costs no recomputation."""
    path = f"{new_run_dir(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(text: str | Column = "text") -> Column:
    """The text, the empty text for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep_one(rows: DataFrame, decision: DataFrame, on: dict[str, str], ties: str) -> DataFrame:
    """The rows of ``rows`` that ``decision`` names, one for each row of ``decision``.

    ``on`` maps columns of ``rows`` to columns of ``decision``, compared null-safely. ``ties`` is
    the column of ``decision`` that counts how many rows share the named values; of those that
    share them, any one stays, as nothing tells them apart.
    """
    named = {k: f"__keep_{i}" for i, k in enumerate(on)}
    chosen = decision.select(
        *[F.col(on[k]).alias(v) for k, v in named.items()], F.col(ties).alias("__ties")
    )
    match = [rows[k].eqNullSafe(F.col(v)) for k, v in named.items()]

    def joined(part: DataFrame) -> DataFrame:
        condition = match[0]
        for m in match[1:]:
            condition = condition & m
        return rows.join(part, condition).drop(*named.values(), "__ties")

    single = joined(chosen.where("__ties = 1"))
    several = chosen.where("__ties > 1")
    if several.isEmpty():
        return single
    return single.unionByName(joined(several).dropDuplicates(list(on)))
