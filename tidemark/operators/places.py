"""Place joins: ZIP directory and borough polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookup import zip_directory

# Height of one latitude band of the polygon index, in degrees (about half a kilometre).
BAND_DEGREES = 0.005


def join_zip_borough(
    df: DataFrame, zip_column: str, ranges: list[tuple] | None = None
) -> DataFrame:
    """Adds ``zip_borough`` from the ZIP ranges (NULL outside them and for shared ZIPs).

    A left hash join; the directory has at most one row per five-digit code.
    """
    directory = zip_directory(df.sparkSession, ranges).withColumnRenamed("zip", "_zip")
    return df.join(
        F.broadcast(directory), F.col(zip_column) == F.col("_zip"), "left"
    ).drop("_zip")


def _band(lat: Column) -> Column:
    return F.when(lat.between(-90.0, 90.0), F.floor(lat / BAND_DEGREES).cast("int"))


def band_index(polygons: DataFrame) -> DataFrame:
    """band -> shapes: for each latitude band, the polygon edges that reach into it.

    ``polygons`` has ``borough``, ``ord`` and ``ring`` (the outer ring as array of lon/lat
    structs). A point only ever has to look at the edges of its own band, in polygon order.
    """
    last = F.size("ring")
    edges = F.transform(
        F.col("ring"),
        lambda p, i: F.struct(
            p["lon"].alias("x"),
            p["lat"].alias("y"),
            F.element_at("ring", F.when(i == 0, last).otherwise(i))["lon"].alias("x0"),
            F.element_at("ring", F.when(i == 0, last).otherwise(i))["lat"].alias("y0"),
        ),
    )
    # Level edges are never crossed by a level ray.
    per_edge = polygons.select("borough", "ord", F.explode(edges).alias("edge")).where(
        "edge.y <> edge.y0"
    )
    bands = F.sequence(
        F.floor(F.least("edge.y", "edge.y0") / BAND_DEGREES).cast("int"),
        F.floor(F.greatest("edge.y", "edge.y0") / BAND_DEGREES).cast("int"),
    )
    per_band = per_edge.select("borough", "ord", F.explode(bands).alias("band"), "edge")
    # Both lists are bounded by the polygon set, never by the data it is joined to.
    return (
        per_band.groupBy("band", "ord", "borough")
        .agg(F.collect_list("edge").alias("edges"), F.max(F.greatest("edge.x", "edge.x0")).alias("max_x"))
        .groupBy("band")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "borough", "max_x", "edges"))).alias("shapes"))
    )


def _crosses(lat: Column, lon: Column, edge: Column) -> Column:
    """Does the ray from the point towards the east cross this edge?"""
    spans = (edge["y"] > lat) != (edge["y0"] > lat)
    cut = (edge["x0"] - edge["x"]) * (lat - edge["y"]) / (edge["y0"] - edge["y"]) + edge["x"]
    return spans & (lon < cut)


def locate_points(
    df: DataFrame, polygons: DataFrame | None, lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """Adds ``found_borough``: the first polygon (by ``ord``) whose outer ring holds the point.

    Without polygons the column is NULL, meaning "not checked".
    """
    if polygons is None:
        return df.withColumn("found_borough", F.lit(None).cast("string"))
    index = band_index(polygons)
    # Spark's size check decides between broadcasting the index and a shuffled join on the band,
    # where AQE splits crowded bands on the point side.
    y, x = F.col(lat), F.col(lon)
    inside = F.filter(
        F.col("shapes"),
        lambda s: (x <= s["max_x"])
        & (F.size(F.filter(s["edges"], lambda e: _crosses(y, x, e))) % 2 == 1),
    )
    return (
        df.withColumn("_band", _band(y))
        .join(index.withColumnRenamed("band", "_band"), "_band", "left")
        .withColumn("found_borough", F.get(inside, F.lit(0))["borough"])
        .drop("_band", "shapes")
    )
