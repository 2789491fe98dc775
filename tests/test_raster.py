import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from emberline.functions.geo import RasterMeta
from emberline.operators import enrich, raster
from emberline.sources.scenes import SceneStore

META = RasterMeta(0.0, 10.0, 1.0, 1.0, 10, 10, -1.0)
DAY = dt.date(2024, 3, 10)


def grid(spark, value=lambda r, c: 12.0, skip=()):
    rows = [(r, c, float(value(r, c))) for r in range(10) for c in range(10) if (r, c) not in skip]
    return spark.createDataFrame(rows, "row int, col int, value double")


def at(spark, *rc):
    """Points in the middle of pixels."""
    rows = [(i, 10.0 - r - 0.5, c + 0.5, DAY) for i, (r, c) in enumerate(rc)]
    return spark.createDataFrame(rows, "id long, lat double, lon double, date date")


def values(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("id").collect()]


def test_pixel_borders(spark):
    p = spark.createDataFrame([(0, 10.0, 0.0), (1, 9.0, 1.0), (2, 0.0, 9.99), (3, 10.1, -0.1)], "id long, lat double, lon double")
    assert values(raster.with_pixel(p, META), "row", "col") == [(0, 0), (1, 1), (10, 9), (-1, -1)]


def test_outside_and_nodata_are_null(spark):
    soil = grid(spark, lambda r, c: -1.0 if (r, c) == (2, 2) else r * 10 + c)
    assert values(raster.sample(at(spark, (3, 4), (2, 2), (20, 1)), soil, META, "v"), "v") == [34.0, None, None]


def test_fill_takes_mode_with_lowest_code_on_ties(spark):
    cover = grid(spark, lambda r, c: -1 if (r, c) == (5, 5) else (30 if c % 2 else 20) if r % 2 else 11)
    # 5 x 5 around (5, 5): rows 3, 5, 7 alternate 30 and 20, rows 4 and 6 are 11.
    assert values(raster.sample_filled(at(spark, (5, 5)), cover, META, "v"), "v") == [11.0]
    even = grid(spark, lambda r, c: {(4, 4): 30, (6, 6): 20}.get((r, c), -1))
    assert values(raster.sample_filled(at(spark, (5, 5)), even, META, "v"), "v") == [20.0]


def test_fill_mean_off_centre(spark):
    cover = grid(spark, lambda r, c: -1 if (r, c) == (5, 5) else r)
    got = values(raster.sample_filled(at(spark, (5, 5)), cover, META, "v", "mean", 5, -3), "v")
    cells = [r for r in range(2, 7) for c in range(2, 7) if (r, c) != (5, 5)]
    assert got == [pytest.approx(sum(cells) / len(cells))]


def test_fill_where_hot_and_other_pixels_are_looked_up(spark, forced_big):
    """Both ways of the lookup read the filled pixels, so their exchanges are reused."""
    n = 20
    cells = {(r, c): -1.0 if (r * n + c) % 7 == 0 else float((r * n + c) % 45) for r in range(n) for c in range(n)}
    cover = spark.createDataFrame([(*rc, v) for rc, v in cells.items()], "row int, col int, value double")
    asked = [*cells] * 3 + [(1, 1)] * 40
    points = spark.createDataFrame([(i, n - r - 0.5, c + 0.5) for i, (r, c) in enumerate(asked)], "id long, lat double, lon double")

    def want(r, c):
        if cells[r, c] >= 0:
            return cells[r, c]
        near = [v for i in range(r - 2, r + 3) for j in range(c - 2, c + 3) if (v := cells.get((i, j), -1.0)) >= 0]
        return min(near, key=lambda v: (-near.count(v), v))

    got = values(raster.sample_filled(points, cover, RasterMeta(0.0, float(n), 1.0, 1.0, n, n, -1.0), "v"), "v")
    assert got == [want(*rc) for rc in asked]


def test_window_without_valid_pixels_is_unusable(spark):
    cover = grid(spark, lambda r, c: -1 if 1 <= r <= 9 and 1 <= c <= 9 else 12)
    coded = raster.sample_filled(at(spark, (5, 5), (0, 0), (1, 1)), cover, META, "code")
    assert values(coded.withColumn("bad", raster.is_unusable(F.col("code"))), "code", "bad") == [
        (None, True),
        (12.0, False),
        (12.0, False),
    ]


def test_labels_only_for_whole_codes_up_to_44(spark):
    legend = spark.createDataFrame([(0, "sea"), (44, "none"), (45, "beyond"), (12, "pine")], "code int, label string")
    codes = spark.createDataFrame([(0, 0.0), (1, 12.0), (2, 12.4), (3, None), (4, 45.0), (5, -1.0), (6, 44.0)], "id long, c double")
    assert values(raster.label(codes, legend, "c", "l"), "l") == ["sea", "pine", "Sin datos", "Sin datos", "Sin datos", "Sin datos", "none"]


def test_slope_of_a_plane_and_at_the_border(spark):
    dem = grid(spark, lambda r, c: c * 1000.0)
    df = enrich.add_terrain(at(spark, (5, 5), (0, 5), (30, 30)), dem, META)
    (z, grade, percent), border, outside = values(df, "elevacion_centro", "grados", "porcentaje")
    run = 111320 * math.cos(math.radians(4.5))
    assert z == 5000.0 and grade == pytest.approx(math.degrees(math.atan(1000 / run)))
    assert percent == pytest.approx(100 * 1000 / run)
    assert border == (5000.0, None, 0.0) and outside == (None, None, 0.0)


@pytest.mark.parametrize("big", [False, True])
def test_weather_by_cell_and_day(spark, big, request):
    from emberline.schema import WEATHER_COLUMNS, WEATHER_DAILY

    if big:
        request.getfixturevalue("forced_big")
    w = spark.createDataFrame([(5, 5, DAY, *[float(i) for i in range(12)]), (5, 5, DAY + dt.timedelta(1), *[9.0] * 12)], WEATHER_DAILY)
    got = enrich.add_weather(at(spark, (5, 5), (5, 6), *[(5, 5)] * 40), w, META)
    assert values(got, *WEATHER_COLUMNS)[:2] == [tuple(float(i) for i in range(12)), (None,) * 12]
    assert got.count() == 42


def test_vegetation_window_clouds_and_median(spark, tmp_path):
    from emberline.schema import S2_CLOUD, S2_SCENE

    def scene(i, days, b3, b4, b8, cell=(5, 5)):
        return (i, *cell, DAY - dt.timedelta(days), float(b3), float(b4), float(b8))

    scenes = spark.createDataFrame(
        [
            scene(1, 0, 1, 1, 9),  # the day itself does not count
            scene(2, 1, 3, 1, 1),
            scene(3, 30, 1, 1, 3),
            scene(4, 31, 1, 1, 9),
            scene(5, 9, 1, 0, 0),  # NDVI undefined
            scene(6, 9, 1, 1, 9),  # cloudy
            scene(7, 9, 1, 1, 9),  # no score
            scene(8, 9, 1, 1, 9, (1, 1)),
        ],
        S2_SCENE,
    )
    clouds = spark.createDataFrame([(i, 0.49 if i == 6 else 0.5) for i in (1, 2, 3, 4, 5, 6, 8)], S2_CLOUD)
    points = at(spark, (5, 5), (5, 6), (5, 5), (-4, 30))
    want = [(0.25, 0.5), (None, None), (0.25, 0.5), (None, None)]
    assert values(enrich.add_veg_index(points, scenes, clouds, META), "NDVI", "NDWI") == want
    store = SceneStore.of(str(tmp_path / "scenes"), META)
    store.write(scenes, clouds)
    assert values(enrich.add_veg_index_stored(points, store, META), "NDVI", "NDWI") == want
    assert values(enrich.add_veg_index_stored(points.limit(0), store, META), "NDVI", "NDWI") == []


def test_only_folders_that_are_asked_for_are_opened(spark, tmp_path):
    from emberline.schema import S2_CLOUD, S2_SCENE

    meta = RasterMeta(0.0, 10.0, 0.01, 0.01, 1000, 1000, -1.0)
    scenes = [(i, 500 + 60 * (i % 3), 500, DAY - dt.timedelta(5 + 40 * (i // 3)), 1.0, 1.0, 3.0) for i in range(12)]
    store = SceneStore.of(str(tmp_path / "scenes"), meta)
    assert store.side == 32 and store.across == 32
    store.write(spark.createDataFrame(scenes, S2_SCENE), spark.createDataFrame([(i, 0.9) for i in range(12)], S2_CLOUD))
    point = spark.createDataFrame([(0, 10.0 - 5.005, 5.005, DAY)], "id long, lat double, lon double, date date")
    waiting = enrich._waiting(raster.with_pixel(point, meta).select(*enrich.CELL_DAY), 30)
    plan = store.near(waiting, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "GreaterThanOrEqual(cs_cdf,0.5)" in plan
    asked = {(r["span"], r["tile"]) for r in waiting.select("span", store.tile(F.col("row"), F.col("col")).alias("tile")).collect()}
    spoiled = 0
    for file in (tmp_path / "scenes").glob("span=*/tile=*/*.parquet"):
        span, tile = (int(p.split("=")[1]) for p in file.parts[-3:-1])
        if (span, tile) not in asked:
            file.write_bytes(b"not parquet")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
            spoiled += 1
    assert spoiled >= 9
    assert values(enrich.add_veg_index_stored(point, store, meta), "NDVI", "NDWI") == [(0.5, -0.5)]


def test_scenes_beyond_the_grid_are_found_and_add_no_folders(spark, tmp_path):
    from emberline.schema import S2_CLOUD, S2_SCENE

    meta = RasterMeta(0.0, 10.0, 0.01, 0.01, 64, 64, -1.0)
    rows = range(-3000, 3000, 20)
    scenes = spark.createDataFrame([(i, r, 7, DAY - dt.timedelta(5), 1.0, 1.0, 3.0) for i, r in enumerate(rows)], S2_SCENE)
    clouds = spark.createDataFrame([(i, 0.9) for i in range(len(rows))], S2_CLOUD)
    store = SceneStore.of(str(tmp_path / "scenes"), meta)
    store.write(scenes, clouds)
    assert len(list((tmp_path / "scenes").glob("span=*/tile=*"))) <= store.down
    points = spark.createDataFrame([(i, 10.0 - (r + 0.5) * 0.01, 0.075, DAY) for i, r in enumerate((-3000, 20, 1000, 5))], "id long, lat double, lon double, date date")
    want = values(enrich.add_veg_index(points, scenes, clouds, meta), "NDVI", "NDWI")
    assert want.count((0.5, -0.5)) == 3
    assert values(enrich.add_veg_index_stored(points, store, meta), "NDVI", "NDWI") == want


def test_extraction_tables_rename_limit_and_filter(spark):
    fires = at(spark, *[(r, 2) for r in range(9)]).withColumnsRenamed({"lat": "lat_mean", "lon": "lon_mean"})
    fires = fires.select("lat_mean", "lon_mean", F.concat("date", F.lit(" 00:00:00")).alias("date_first"))
    soil = grid(spark, lambda r, c: r)
    got = enrich.soil(fires, soil, META, limit=4)
    assert got.columns == ["SOC", "lat", "lon", "date"]
    assert sorted(r["SOC"] for r in got.collect()) == [5.0, 6.0, 7.0, 8.0]
    assert enrich.soil(fires, soil, META, limit=-1).count() == 9
    assert enrich.soil(fires, soil, META, limit=-1, start=DAY + dt.timedelta(1)).count() == 0
