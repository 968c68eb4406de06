"""Column functions against tables of cases."""

import math
import random
from datetime import datetime

from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import geo, numbers, text, times
from tidemark.operators.standardize import standardize


def apply(spark, values, fn, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    # A table of parts, so that nothing is folded on the driver.
    out = rows.repartition(3).select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]


def check(spark, cases, fn):
    got = apply(spark, [c for c, _ in cases], fn)
    wrong = {c: g for (c, want), g in zip(cases, got) if g != want}
    assert not wrong


def test_zip(spark):
    """Five digits, with or without four more and whatever stands between; all else is NULL."""
    rnd = random.Random(31)
    cases = []
    for _ in range(12):
        five, four = f"{rnd.randrange(1, 100_000):05d}", f"{rnd.randrange(10_000):04d}"
        cases += [(five, five), (f"\t{five} ", five)]
        cases += [(five + between + four, five) for between in ("", "-", " - ", "- ")]
        cases += [(five[:4], None), (five + "7", None), (f"zip {five[:3]}", None)]
    cases += [(None, None), ("", None), ("-", None), ("0" * 5, None), ("none given", None)]
    check(spark, dict(cases).items(), lambda c: text.zip5(text.zip_digits(c)))


def test_address(spark):
    cases = [
        ("908 North 7th Avenue", "908 N 7 AVE"),
        ("908 n. 7 AVE.", "908 N 7 AVE"),
        ("4410  South   Cedar Street", "4410 S CEDAR ST"),
        ("4410 S CEDAR ST", "4410 S CEDAR ST"),
        ("7 Southeast 3rd Road", "7 SE 3 RD"),
        ("81-16 Lantern  Boulevard", "81 16 LANTERN BLVD"),
        ("Second 2ROAD", "SECOND 2ROAD"),
        ("  \t ", None),
        ("..", None),
        (None, None),
    ]
    check(spark, cases, lambda c: F.nullif(text.address_key(c), F.lit("")))


def test_borough(spark):
    """Every known spelling in any case and spacing; anything longer or unknown is NULL."""
    cases = []
    for spelling, borough in fixed.BOROUGH_SPELLINGS:
        cases += [(spelling, borough), (spelling.lower(), borough), (f" {spelling.title()}  ", borough)]
        cases += [(spelling.replace(" ", " \t "), borough), (f"{spelling} COUNTY SEAT", None)]
    cases += [("Westchester", None), ("?", None), ("", None), (None, None)]
    check(spark, dict(cases).items(), lambda c: text.borough_name(text.collapse_spaces(c)))


def test_clean_text(spark):
    cases = [
        ("  a \t b\n\nc ", "a b c"),
        ("a  b\x1fc", "a b c"),
        ("tidy text", "tidy text"),
        ("très  bien", "très bien"),
        ("你好　世", "你好 世"),
        ("   ", None),
        ("", None),
        (None, None),
        ("x" * 50, "x" * 20),
    ]
    check(spark, cases, lambda c: text.clean_text(c, 20))


def test_times(spark):
    utc = datetime
    cases = [
        ("2026-09-02T09:14:00.000", utc(2026, 9, 2, 9, 14)),
        ("2026-09-02 09:14", utc(2026, 9, 2, 9, 14)),
        ("2026-09-02", utc(2026, 9, 2)),
        (" 2026-09-02T09:14:00Z ", utc(2026, 9, 2, 9, 14)),
        ("2026-09-02T09:14:00+02:00", utc(2026, 9, 2, 7, 14)),
        ("2026-09-02T09:14:00.123456-05:30", utc(2026, 9, 2, 14, 44, 0, 123456)),
        ("1788549731", utc(2026, 9, 4, 19, 22, 11)),
        ("1788549731.5", utc(2026, 9, 4, 19, 22, 11, 500000)),
        ("999999999", utc(2001, 9, 9, 1, 46, 39)),
        ("2026-09-02T09", utc(2026, 9, 2, 9)),
        ("2026-09-02T09+03:00", utc(2026, 9, 2, 6)),
        ("2026-09-02 09Z", utc(2026, 9, 2, 9)),
        ("99999999999999", None),
        ("2026", None),
        ("12:00", None),
        ("20260902T091400", None),
        ("2026-13-02", None),
        ("2026-02-30T00:00:00", None),
        ("not a date", None),
        ("", None),
        (None, None),
    ]
    as_text = [(c, w and w.strftime("%Y-%m-%d %H:%M:%S.%f")) for c, w in cases]
    check(
        spark,
        as_text,
        lambda c: F.date_format(times.parse_time(text.strip(c)), "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    )


def test_update_time_takes_the_first_readable_field(spark):
    rows = [
        ("1788549731", None, None),
        ("1788549731.25", None, None),
        (None, "2026-09-04T19:22:11", None),
        ("rubbish", None, "1788549731"),
        ("99999999999999999999", "1788549731", None),
        (None, None, None),
    ]
    feed = spark.createDataFrame(rows, "`:updated_at` string, updated_at string, `:updated_at_meta` string")
    got = [
        r[0]
        for r in standardize(feed)
        .select(F.date_format("source_updated_at", "yyyy-MM-dd HH:mm:ss"))
        .collect()
    ]
    assert got == ["2026-09-04 19:22:11"] * 5 + [None]


def test_numbers(spark):
    cases = [
        ("40.6626", 40.6626),
        (" -73.9 ", -73.9),
        ("1e3", 1000.0),
        ("1_000.5", 1000.5),
        (".5", 0.5),
        ("5.", 5.0),
        ("inf", float("inf")),
        ("1d", None),
        ("1f", None),
        ("0x1p3", None),
        ("", None),
        ("N/A", None),
        (None, None),
    ]
    check(spark, cases, lambda c: numbers.parse_number(text.strip(c)))
    nan = apply(spark, ["nan", "-NaN"], numbers.parse_number)
    assert all(v != v for v in nan)


def test_number_text(spark):
    values = [40.7, 0.0, -118.24, 1e-5, 0.0005, 12345678.5, 1e16, 1.5e300, 123456789012.0, None]
    assert apply(spark, values, numbers.number_text, "double") == [str(v) for v in values]


def test_duration_and_iso_text(spark):
    from datetime import timedelta

    micros = [61_000_000, 7_200_000_000, 90_061_000_005, 2 * 86_400_000_000, 3_900_000_000]
    expected = [str(timedelta(microseconds=m)) for m in micros]
    assert apply(spark, micros, times.duration_text, "bigint") == expected
    got = apply(
        spark,
        ["2026-09-04 19:22:11", "2026-09-04 19:22:11.000120"],
        lambda c: times.iso_text(c.cast("timestamp")),
    )
    assert got == ["2026-09-04T19:22:11+00:00", "2026-09-04T19:22:11.000120+00:00"]


def test_category_passes_unknown_labels_through(spark):
    labels = ["Heating", "HEAT/HOT WATER", "noise  residential", "Some Brand New", "", None, " "]
    feed = spark.createDataFrame(list(enumerate(labels)), "i int, complaint_type string")
    got = {
        r["i"]: (r["complaint_type_norm"], r["known_category"])
        for r in standardize(feed, keep=("i",)).collect()
    }
    assert got == {
        0: ("HEAT/HOT WATER", True),
        1: ("HEAT/HOT WATER", True),
        2: ("NOISE - RESIDENTIAL", True),
        3: ("SOME BRAND NEW", False),
        4: (None, False),
        5: (None, False),
        6: (None, False),
    }


def test_empty_address_falls_back_to_street_name(spark):
    feed = spark.createDataFrame(
        [("", "Main Street"), (None, "Main Street"), (" ", "Main Street"), ("1 Elm Rd", "x")],
        "incident_address string, street_name string",
    )
    assert [r[0] for r in standardize(feed).select("address_norm").collect()] == [
        "MAIN ST",
        "MAIN ST",
        None,
        "1 ELM RD",
    ]


def test_zip_and_borough(spark):
    """The ends of each range belong to its borough, the codes beyond to another or none; a shared
    code agrees with each of its boroughs."""
    shared = dict(fixed.SHARED_ZIPS)
    ranges = fixed.ZIP_RANGES
    rows = []
    for low, high, borough in ranges:
        for code in (low - 1, low, (low + high) // 2, high, high + 1):
            owner = next((b for lo, hi, b in ranges if lo <= code <= hi), None)
            zip5 = f"{code:05d}"
            if zip5 not in shared:
                rows.append((zip5, borough, owner, None if owner is None else owner == borough))
    for zip5, boroughs in shared.items():
        rows += [(zip5, b, None, b in boroughs) for b in {b for _, _, b in ranges}]
    rows += [(None, "QUEENS", None, None), ("zip", "QUEENS", None, None)]
    rows += [(f"{ranges[0][0]:05d}", None, ranges[0][2], None)]
    frame = spark.createDataFrame(rows, "z string, b string, found string, agrees boolean")
    frame = frame.repartition(2).withColumn("got", geo.borough_of_zip(F.col("z")))
    agrees = geo.zip_matches_borough(F.col("z"), F.col("got"), F.col("b"))
    wrong = frame.where(
        ~F.col("got").eqNullSafe(F.col("found")) | ~agrees.eqNullSafe(F.col("agrees"))
    )
    assert wrong.collect() == []


def test_points(spark):
    nan = float("nan")
    low, high = fixed.BBOX_MIN_LAT, fixed.BBOX_MAX_LAT
    west, east = fixed.BBOX_MIN_LON, fixed.BBOX_MAX_LON
    points = [
        ((low + high) / 2, (west + east) / 2, None),
        (low, west, None),
        (high, east, None),
        ((west + east) / 2, (low + high) / 2, "coords_swapped"),
        (low - 0.001, west, "coords_outside_nyc"),
        (51.5, -0.12, "coords_outside_nyc"),
        (0.0, 0.0, "coords_null_island"),
        (-1e-8, 1e-8, "coords_null_island"),
        (None, None, "coords_missing"),
        (None, east, "coords_partial"),
        (nan, west, "coords_outside_nyc"),
    ]
    df = spark.createDataFrame(points, "lat double, lon double, want string")
    bad = df.where(~geo.coordinate_class(F.col("lat"), F.col("lon")).eqNullSafe(F.col("want")))
    assert bad.collect() == []


def test_distance(spark):
    """Along a meridian a degree is a 360th of the way round; across, it shrinks by the cosine."""
    degree = 6371.0088 * math.pi / 180
    pairs = [((10.0, 20.0, 11.0, 20.0), degree), ((60.0, 5.0, 60.0, 5.5), degree / 4), ((1.0, 2.0, 1.0, 2.0), 0.0)]
    for points, want in pairs:
        km = spark.range(1).select(geo.distance_km(*map(F.lit, points))).first()[0]
        assert math.isclose(km, want, rel_tol=2e-3, abs_tol=1e-9)
