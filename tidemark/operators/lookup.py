"""Small fixed tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed


def literal_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A table written out in the plan itself: its size is known and reading it takes no job."""

    def text(value) -> str:
        return f"'{value}'" if isinstance(value, str) else str(value)

    values = ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def category_table(spark: SparkSession) -> DataFrame:
    """category_key -> canonical_category. Tens of fixed rows, so broadcasting is safe."""
    return literal_table(
        spark, ["category_key", "canonical_category"], fixed.CATEGORY_ALIASES
    )


def rule_table(spark: SparkSession) -> DataFrame:
    """rule, severity, ord: every built-in rule, in report order."""
    rows = [(name, severity, i) for i, (name, severity, _) in enumerate(fixed.RULES)]
    return literal_table(spark, ["rule", "severity", "ord"], rows)


def zip_directory(spark: SparkSession, ranges: list[tuple] | None = None) -> DataFrame:
    """zip -> borough, one row per ZIP of the inclusive ``(first, last, borough)`` ranges; where
    ranges overlap the first one counts.

    Unrolling the ranges turns the range lookup into a hash join on the ZIP. Bounds beyond five
    digits are refused, so the table has at most 100 000 rows whatever the ranges are.
    """
    ranges = fixed.ZIP_RANGES if ranges is None else ranges
    if not all(0 <= lo <= 99_999 and 0 <= hi <= 99_999 for lo, hi, _ in ranges):
        raise ValueError("ZIP ranges must lie between 0 and 99999")
    shared = [z for z, _ in fixed.SHARED_ZIPS]
    numbered = [(*r, i) for i, r in enumerate(ranges)]
    table = literal_table(spark, ["lo", "hi", "zip_borough", "ord"], numbered)
    return (
        table.select(F.explode(F.sequence("lo", "hi")).alias("n"), "zip_borough", "ord")
        .groupBy(F.lpad(F.col("n").cast("string"), 5, "0").alias("zip"))
        .agg(F.min_by("zip_borough", "ord").alias("zip_borough"))
        .where(~F.col("zip").isin(shared))
    )
