"""Place columns: ZIP to borough, bounding box, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed


def _shared(zip5: Column) -> Column:
    return zip5.isin([z for z, _ in fixed.SHARED_ZIPS])


def borough_of_zip(zip5: Column) -> Column:
    """The one borough a ZIP belongs to; NULL outside the city and for shared ZIPs.

    Five-digit codes compare as text in the same order as as numbers.
    """
    branch = F.when(_shared(zip5) | (F.length(zip5) != 5), F.lit(None).cast("string"))
    for lo, hi, borough in fixed.ZIP_RANGES:
        branch = branch.when(zip5.between(f"{lo:05d}", f"{hi:05d}"), F.lit(borough))
    return branch


def zip_in_city(zip5: Column, zip_borough: Column) -> Column:
    """``zip_borough`` is :func:`borough_of_zip` of the same ZIP."""
    return F.coalesce(zip_borough.isNotNull() | _shared(zip5), F.lit(False))


def zip_matches_borough(zip5: Column, zip_borough: Column, borough: Column) -> Column:
    """True or false when both sides have an opinion, else NULL."""
    branch = None
    for shared, allowed in fixed.SHARED_ZIPS:
        found = borough.isin(allowed)
        branch = F.when(zip5 == shared, found) if branch is None else branch.when(zip5 == shared, found)
    return branch.otherwise(zip_borough == borough)


def in_city_box(lat: Column, lon: Column) -> Column:
    inside = lat.between(fixed.BBOX_MIN_LAT, fixed.BBOX_MAX_LAT) & lon.between(
        fixed.BBOX_MIN_LON, fixed.BBOX_MAX_LON
    )
    return F.coalesce(inside, F.lit(False))


def is_zero_point(lat: Column, lon: Column) -> Column:
    eps = fixed.ZERO_TOLERANCE
    return F.coalesce((F.abs(lat) < eps) & (F.abs(lon) < eps), F.lit(False))


def looks_swapped(lat: Column, lon: Column) -> Column:
    return ~in_city_box(lat, lon) & in_city_box(lon, lat)


def coordinate_class(lat: Column, lon: Column) -> Column:
    """Name of the one coordinate rule a point fails, NULL when it is fine."""
    return (
        F.when(lat.isNull() & lon.isNull(), F.lit("coords_missing"))
        .when(lat.isNull() | lon.isNull(), F.lit("coords_partial"))
        .when(is_zero_point(lat, lon), F.lit("coords_null_island"))
        .when(looks_swapped(lat, lon), F.lit("coords_swapped"))
        .when(~in_city_box(lat, lon), F.lit("coords_outside_nyc"))
    )


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine)."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * fixed.EARTH_RADIUS_KM) * F.asin(F.sqrt(h))
