import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import geo, rounding
from emberline.functions.dates import clamped_date, parse_date
from emberline.functions.uniform import digest, draw


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_projection_check_points(spark):
    x, y = geo.to_6933(F.lit(180.0), F.lit(85.0445664))
    u, v = geo.to_3035(F.lit(5.0), F.lit(50.0))
    got = one(spark, x, y, u, v)
    assert got[:2] == pytest.approx((17367530.445, 7314540.831), abs=2e-3)
    assert got[2:] == pytest.approx((3962799.45, 2999718.85), abs=1e-2)


def test_haversine_is_symmetric_and_safe_at_antipodes(spark):
    d = geo.haversine_km
    a, b, c = one(
        spark,
        d(F.lit(40.0), F.lit(-3.0), F.lit(41.0), F.lit(2.0)),
        d(F.lit(41.0), F.lit(2.0), F.lit(40.0), F.lit(-3.0)),
        d(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)),
    )
    assert a == pytest.approx(b) and 430 < a < 440
    assert c == pytest.approx(math.pi * 6371.0)


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_ring_area_perimeter_open_and_closed(spark):
    square = [(0, 0), (2, 0), (2, 1), (0, 1)]
    got = one(
        spark,
        geo.ring_area(ring(*square)),
        geo.ring_area(ring(*square, square[0])),
        geo.ring_area(ring(*square[::-1])),
        geo.ring_perimeter(ring(*square)),
    )
    assert tuple(got) == (2.0, 2.0, -2.0, 6.0)


@pytest.mark.parametrize(
    "x, y, inside", [(1, 0.5, True), (1, 1.5, False), (-1, 0.5, False), (0.1, 0.9, True), (1.0, 0.0, True), (1.0, 1.0, False)]
)
def test_point_in_ring_counts_each_border_once(spark, x, y, inside):
    square = ring((0, 0), (2, 0), (2, 1), (0, 1))
    assert one(spark, geo.point_in_ring(F.lit(float(x)), F.lit(float(y)), square))[0] is inside


def test_buffered_area_of_point_segment_and_square(spark):
    grown = geo.buffered_area
    got = one(
        spark, grown(F.lit(0.0), F.lit(0.0), 2.0), grown(F.lit(0.0), F.lit(6.0), 2.0), grown(F.lit(1.0), F.lit(4.0), 0.5)
    )
    assert tuple(got) == pytest.approx((4 * math.pi, 12 + 4 * math.pi, 3 + math.pi / 4))


def test_destination_uses_radians_unless_asked(spark):
    lat, lon = geo.destination(F.lit(40.0), F.lit(0.0), F.lit(10000.0), F.lit(90.0))
    old_lat, _ = geo.destination(F.lit(40.0), F.lit(0.0), F.lit(10000.0), F.lit(90.0), compat_degrees=True)
    got = one(spark, lat, geo.haversine_km(F.lit(40.0), F.lit(0.0), lat, lon), old_lat)
    assert got[0] == pytest.approx(40.0, abs=1e-9)
    assert got[1] == pytest.approx(10.0, rel=0.01)
    assert got[2] == pytest.approx(40.0 + 10000 * math.cos(90) / 111320)


def test_three_roundings(spark):
    np2, py2, n = rounding.np_round(F.lit(36.125)), rounding.py_round(F.lit(28.125)), rounding.to_count(F.lit(2.5))
    got = one(spark, np2, py2, n, F.round(F.lit(28.125), 2))
    assert tuple(got) == (36.12, 28.12, 2, 28.13)


def test_dates(spark):
    got = one(
        spark,
        clamped_date(F.lit(2023), F.lit(2), F.lit(31)),
        parse_date(F.lit("2024-05-06 07:08:09")),
        parse_date(F.lit("06/05/2024")),
        parse_date(F.lit("13/05/2024")),
        parse_date(F.lit("2024-02-30")),
        parse_date(F.lit("soon")),
    )
    assert [str(v) for v in got] == ["2023-02-28", "2024-05-06", "2024-06-05", "2024-05-13", "None", "None"]


def test_draws_match_the_documented_hash(spark):
    d = digest(42, F.lit("a"), F.lit(1))
    got = one(spark, *[draw(d, i) for i in range(4)])
    assert got[0] == 3663230981 / 2**32
    assert all(0 <= v < 1 for v in got) and len(set(got)) == 4


@pytest.mark.parametrize("crs", ["EPSG:3035", "EPSG:6933"])
def test_projections_there_and_back(spark, crs):
    places = [(lon * 1.0, lat * 1.0) for lon in range(-30, 61, 15) for lat in range(-60, 85, 12)] + [(10.0, 52.0), (0.0, 0.0)]
    df = spark.createDataFrame(places, "lon double, lat double")
    x, y = geo.PROJECTIONS[crs](F.col("lon"), F.col("lat"))
    met = df.withColumns({"x": x, "y": y})
    lon, lat = geo.UNPROJECTIONS[crs](F.col("x"), F.col("y"))
    worst = met.select(F.max(F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))))).first()[0]
    assert worst < 1e-9


def test_known_places_back(spark):
    lon, lat = geo.from_3035(F.lit(3962799.45), F.lit(2999718.85))
    assert tuple(one(spark, lon, lat)) == pytest.approx((5.0, 50.0), abs=1e-7)
    lon, lat = geo.from_6933(F.lit(17367530.445), F.lit(7314540.831))
    assert tuple(one(spark, lon, lat)) == pytest.approx((180.0, 85.0445664), abs=1e-6)
    with pytest.raises(ValueError, match="EPSG:1"):
        geo.ring_to_4326(F.col("ring"), "EPSG:1")
