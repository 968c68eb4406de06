"""Run options and session settings."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunConfig:
    """Options of one run. ``as_of`` is the explicit "now" of every time-relative operator."""

    as_of: datetime
    dedup_window_minutes: int = 60
    raw_retention_days: int = 7
    clean_retention_days: int = 60
    run_retention_days: int = 365
    start_days_back: int = 3
    max_files_per_trigger: int = 6
    stale_after_minutes: int = 180
    storage_budget_bytes: int = 512 * 1024 * 1024

    @property
    def as_of_col(self) -> Column:
        return timestamp_literal(self.as_of)


def timestamp_literal(moment: datetime | str) -> Column:
    """A UTC timestamp literal; naive datetimes are read as UTC."""
    if isinstance(moment, datetime):
        offset = moment.utcoffset()
        text = (moment - offset if offset else moment).strftime("%Y-%m-%d %H:%M:%S.%f")
    else:
        text = moment
    return F.expr(f"TIMESTAMP'{text}+00:00'")


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on. All are session-level and safe on a shared cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
    # The JVM does not compile methods above 8000 bytes. Wide rule projections fused into one
    # method would run interpreted; above this size Spark keeps its operators apart instead.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


_single_process: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session whose driver and executors are one process (``local[...]``, as
    in tests) gets a temporary folder; for any other the folder would not be visible to all
    machines, so it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = _single_process.get(context.applicationId)
        if not folder:
            folder = _single_process[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder name below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4()}"
