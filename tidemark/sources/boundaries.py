"""Polygons of boroughs, or of other named areas, from a GeoJSON file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixed_values import BOROUGH_SPELLINGS

_GEOJSON = (
    "features array<struct<properties:struct<boro_name:string,BoroName:string>,"
    "geometry:struct<type:string,coordinates:string>>>"
)
_POLYGON = "array<array<array<double>>>"


def read_boundaries(
    spark: SparkSession, path: str, expected: int | None = 5, names: list[str] | None = None
) -> DataFrame:
    """borough, ord, ring: the outer ring of every polygon, in file order.

    ``names`` are the areas wanted, in upper case, the five boroughs by default; other features are
    passed over. Holes are left out. Fails when the file does not give the expected number of areas.
    """
    boroughs = sorted({b for _, b in BOROUGH_SPELLINGS}) if names is None else names
    features = spark.read.schema(_GEOJSON).option("multiLine", True).json(path)
    one = features.select(F.posexplode("features").alias("feature", "f")).select(
        "feature",
        F.upper(F.trim(F.coalesce("f.properties.boro_name", "f.properties.BoroName"))).alias("borough"),
        F.col("f.geometry.type").alias("type"),
        F.col("f.geometry.coordinates").alias("text"),
    )
    polygons = F.when(
        F.col("type") == "MultiPolygon", F.from_json("text", f"array<{_POLYGON}>")
    ).when(F.col("type") == "Polygon", F.array(F.from_json("text", _POLYGON)))
    exploded = one.where(F.col("borough").isin(boroughs)).select(
        "borough", "feature", F.posexplode(polygons).alias("part", "polygon")
    )
    outer = F.get("polygon", F.lit(0))
    ring = F.transform(outer, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    # A borough keeps the place of its first feature; its own polygons follow file order.
    first = exploded.groupBy("borough").agg(F.min("feature").cast("bigint").alias("first"))
    out = (
        exploded.where(F.size(outer) > 0)
        .join(F.broadcast(first), "borough")
        .select(
            "borough",
            F.expr("first * 1000000000000 + feature * 1000000L + part").alias("ord"),
            ring.alias("ring"),
        )
    )
    if expected is not None:
        found = out.select("borough").distinct().count()
        if found != expected:
            raise ValueError(f"expected {expected} boroughs, found {found}")
    return out


def build_boundaries(
    spark: SparkSession, geojson: str, path: str, names: list[str] | None = None
) -> DataFrame:
    """Reads the GeoJSON file, checks that every wanted area is there, and stores the polygons at
    ``path``, where :func:`load_boundaries` finds them. A file that lacks an area changes nothing."""
    wanted = len({b for _, b in BOROUGH_SPELLINGS}) if names is None else len(set(names))
    read_boundaries(spark, geojson, wanted, names).write.mode("overwrite").parquet(path)
    return load_boundaries(spark, path)


def load_boundaries(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Stored polygons, or None when there are none: the polygon rule is then not checked."""
    return spark.read.parquet(path) if path else None
