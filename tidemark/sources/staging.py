"""Tables written between steps, where all executors can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import new_run_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back, so that a lost executor recomputes nothing and a
    loop doesn't grow its plan."""
    path = f"{new_run_dir(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by_day(df: DataFrame, time: str, name: str) -> DataFrame:
    """As :func:`written`, in a folder a day of ``time``; ``part`` is the day, yyyy-MM-dd."""
    path = f"{new_run_dir(df.sparkSession, name)}/rows"
    rows = df.withColumn("part", F.date_format(time, "yyyy-MM-dd"))
    rows.hint("rebalance", "part").write.partitionBy("part").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)
