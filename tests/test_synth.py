import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberline.functions.geo import RasterMeta, haversine_km
from emberline.operators import synth, zones
from emberline.schema import FIRE_EVENT

META = RasterMeta(-10.0, 56.0, 0.5, 0.5, 42, 82, -1.0)
BOX = [(0.0, 40.0), (4.0, 40.0), (4.0, 44.0), (0.0, 44.0)]
EAST = [(10.0, 40.0), (14.0, 40.0), (14.0, 44.0), (10.0, 44.0)]
FAR_WEST = [(-30.0, 40.0), (-20.0, 40.0), (-20.0, 45.0)]


def masks(spark, **rings):
    schema = "region string, part int, ring array<struct<x: double, y: double>>"
    return zones.edges_from_rings(spark.createDataFrame([(n, 0, r) for n, r in rings.items()], schema))


def fires(spark, *rows):
    """(lat, lon, power, date) rows."""
    full = [(f"f{i}", a, o, p, p, 5 - i, d, d, 1, 1.0) for i, (a, o, p, d) in enumerate(rows)]
    return spark.createDataFrame(full, FIRE_EVENT)


def cover(spark, value=12.0):
    cells = spark.range(42 * 82)
    return cells.select(
        F.floor(F.col("id") / 82).cast("int").alias("row"), (F.col("id") % 82).cast("int").alias("col"), F.lit(value).alias("value")
    )


JUNE_30, JAN_31 = dt.date(2023, 6, 30), dt.date(2024, 1, 31)


def test_month_counts_own_month_and_remainder(spark):
    plan = fires(spark, (41.0, 1.0, 5.0, JUNE_30)).withColumn("n_near", F.lit(26).cast("long"))
    got = {r["month"]: r["n"] for r in synth.spread_over_year(plan).collect()}
    assert got == {m: 2 + (m <= 2) - (m == 6) for m in range(1, 13)}
    few = fires(spark, (41.0, 1.0, 5.0, JUNE_30)).withColumn("n_near", F.lit(3).cast("long"))
    assert {r["month"]: r["n"] for r in synth.spread_over_year(few).collect()} == {m: int(m <= 3) for m in range(1, 13)}


def points_of(spark, all_fires, edges, value=12.0, **kw):
    return synth.synthetic_points(all_fires, edges, cover(spark, value), META, **kw)


def test_whole_generation(spark):
    all_fires = fires(spark, (41.0, 1.0, 30.0, JUNE_30), (42.0, 3.0, 10.0, JAN_31))
    got = points_of(spark, all_fires, masks(spark, A=BOX, B=EAST)).cache()
    near = got.where("source = 'near'")
    # Equal areas: A gets (0.5 + 0.25) and B 0.25 of 60 points; A's 45 are shared 34 : 11 by power.
    months = {m: 2 + (m <= 10) - (m == 6) for m in range(1, 13)}
    assert near.where("point_id LIKE '%:f0:%'").count() == sum(months.values()) == 33
    assert near.where("point_id LIKE '%:f1:%'").count() == 10
    assert got.where("source = 'random'").groupBy("region").count().collect() == [("B", 24)]
    assert got.select("point_id").distinct().count() == got.count()
    assert {r[0].day for r in near.select("date").distinct().collect()} == {28}
    assert {r[0] for r in near.where("point_id LIKE '%:f0:%'").select(F.year("date")).distinct().collect()} == {2023}
    met = near.withColumn("fire_id", F.split("point_id", ":")[2]).join(all_fires, "fire_id")
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("lat_mean"), F.col("lon_mean"))
    low, high = met.agg(F.min(d), F.max(d)).first()
    assert low >= 4.95 and high <= 10.1
    box = got.where("source = 'random'").agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    assert 40 <= box[0] and box[1] <= 44 and 10 <= box[2] and box[3] <= 14


def test_same_seed_same_points_on_any_partitioning(spark):
    all_fires = fires(spark, (41.0, 1.0, 30.0, JUNE_30), (42.0, 3.0, 10.0, JAN_31), (41.5, 12.0, 8.0, JAN_31))
    edges = masks(spark, A=BOX, B=EAST)
    rows = lambda df: sorted(map(tuple, df.collect()))
    first = rows(points_of(spark, all_fires, edges))
    assert rows(points_of(spark, all_fires.repartition(5), edges.repartition(3))) == first
    assert rows(points_of(spark, all_fires, edges, seed=43)) != first


def test_without_power_all_points_are_random(spark):
    got = points_of(spark, fires(spark, (41.0, 1.0, 0.0, JUNE_30)), masks(spark, A=BOX))
    assert [tuple(r) for r in got.groupBy("source").count().collect()] == [("random", 36)]
    assert {r[0] for r in got.select(F.year("date")).distinct().collect()} == {2023}


def test_rejected_points_go_to_the_remainder_and_water_yields_none(spark):
    one = fires(spark, (41.0, 1.0, 5.0, JUNE_30))
    edges = masks(spark, A=BOX)
    assigned = zones.assign_region(one, edges)
    quota = synth.quotas(assigned, edges, 1)
    near = synth.near_counts(assigned, quota, 1)
    candidates = synth.near_candidates(synth.spread_over_year(near), 42)
    checked = synth.checked(candidates, one, 1, cover(spark, 36.0), META)
    assert checked.where("valid").count() == 0
    # All 30 planned, 29 drawn (own month), 29 rejected: 30 - 30 + 29 -> 3 a month.
    assert synth.random_plan(quota, near, checked, edges).first()["n"] == 3
    assert points_of(spark, one, edges, 36.0).count() == 0


def test_region_outside_the_study_area_gets_no_random_points(spark):
    got = points_of(spark, fires(spark, (41.0, 1.0, 5.0, JUNE_30)), masks(spark, A=BOX, W=FAR_WEST))
    assert got.where("region = 'W'").count() == 0


def test_inside_keeps_random_points_in_the_polygon(spark):
    triangle = [(0.0, 40.0), (4.0, 40.0), (4.0, 44.0)]
    one = fires(spark, (50.0, 20.0, 5.0, JUNE_30))
    loose, strict = (points_of(spark, one, masks(spark, T=triangle), per_fire=200, inside=i) for i in (False, True))
    above = "lat - 40 > lon"
    assert loose.where(above).count() > 20 and strict.where(above).count() == 0 and strict.count() > 50


def test_a_point_on_a_fire_is_no_non_fire(spark):
    one = fires(spark, (41.0, 1.0, 5.0, JUNE_30))
    p = spark.createDataFrame([(1, 41.0, 1.0), (2, 41.0, 1.5), (3, None, 1.0)], "id long, lat double, lon double")
    assert sorted(r["id"] for r in synth.not_a_fire(p, one).collect()) == [2, 3]


def test_one_fire_with_nearly_all_power(spark, forced_big):
    many = fires(spark, (41.0, 1.0, 1e6, JUNE_30), *[(40.5 + i * 0.01, 2.0, 1.0, JAN_31) for i in range(40)])
    got = points_of(spark, many, masks(spark, A=BOX))
    assert got.where("source = 'near'").count() > 1100
    assert got.select("point_id").distinct().count() == got.count()


@pytest.mark.parametrize("n_fires", [0, 7])
def test_quota_shares_add_up(spark, n_fires):
    all_fires = fires(spark, *[(41.0, 0.5 + i / 3, 5.0, JUNE_30) for i in range(n_fires)])
    edges = masks(spark, A=BOX, B=EAST)
    quota = synth.quotas(zones.assign_region(all_fires, edges), edges, n_fires)
    assert abs(quota.agg(F.sum("quota")).first()[0] - 30 * n_fires) <= 2
