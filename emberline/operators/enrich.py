"""Environment of points. ``add_*`` append columns; the functions without prefix return the extracted table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.dates import day_prefix
from emberline.functions.geo import RasterMeta
from emberline.operators import clean, raster
from emberline.operators.lineage import settle
from emberline.operators.quantiles import quantiles
from emberline.operators.skew import key_counts, lookup
from emberline.schema import WEATHER_COLUMNS
from emberline.sources.scenes import SceneStore

CELL_DAY = ["row", "col", "date"]
WINDOW_DAYS = 30
CLEAR_SKY = 0.5


Counts = tuple[DataFrame, int, int]


def cell_days(points: DataFrame, meta: RasterMeta) -> Counts:
    """Points per (cell, day), to be worked out once where several enrichments follow each other."""
    return key_counts(raster.with_pixel(points, meta), CELL_DAY)


def cells(points: DataFrame, meta: RasterMeta) -> Counts:
    """Points per cell."""
    return key_counts(raster.with_pixel(points, meta), raster.PIXEL)


def add_weather(points: DataFrame, weather_daily: DataFrame, meta: RasterMeta, counts: Counts | None = None) -> DataFrame:
    """The twelve daily variables of the point's cell and day; all NULL if there are none."""
    at = raster.with_pixel(points, meta)
    return lookup(at, weather_daily.select(*CELL_DAY, *WEATHER_COLUMNS), CELL_DAY, counts=counts).drop("row", "col")


def _waiting(need: DataFrame, window_days: int) -> DataFrame:
    """``row, col, span, dates``: the days of a cell whose look-back touches a span of the calendar.

    A look-back of ``window_days`` touches two spans of that length, so scenes meet it by equality of cell and span; the days that
    wait for a span of a cell are fewer than twice ``window_days``.
    """
    day = F.unix_date("date")
    span = lambda d: F.floor(d / window_days).cast("int")
    return (
        need.withColumn("span", F.explode(F.sequence(span(day - window_days), span(day - 1))))
        .groupBy("row", "col", "span")
        .agg(F.collect_list("date").alias("dates"))
    )


def _in_window(window_days: int):
    return lambda d: (F.col("obs_date") < d) & (F.col("obs_date") >= F.date_sub(d, window_days))


def _medians(used: DataFrame) -> DataFrame:
    """``row, col, date, NDVI, NDWI`` from scenes with the ``dates`` they count for."""
    ratio = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b))
    values = settle(
        used.select(
            "row", "col", F.explode("dates").alias("date"), ratio("b8", "b4").alias("NDVI"), ratio("b3", "b8").alias("NDWI")
        ),
        "indices",
    )
    both = values.select(*CELL_DAY, F.explode(F.array(*[F.struct(F.lit(c).alias("band"), F.col(c).alias("v")) for c in ("NDVI", "NDWI")])).alias("e"))
    medians = quantiles(both.select(*CELL_DAY, "e.band", "e.v"), [*CELL_DAY, "band"], "v", {"median": 0.5})
    return medians.groupBy(*CELL_DAY).agg(
        *[F.max(F.when(F.col("band") == c, F.col("median"))).alias(c) for c in ("NDVI", "NDWI")]
    )


def add_veg_index(
    points: DataFrame,
    scenes: DataFrame,
    clouds: DataFrame,
    meta: RasterMeta,
    window_days: int = WINDOW_DAYS,
    clear_sky: float = CLEAR_SKY,
    counts: Counts | None = None,
) -> DataFrame:
    """Median NDVI and NDWI of the clear scenes in the ``window_days`` before the point's day (day excluded).

    Each (cell, day) is worked out once. Scenes outside the days of all points are left out where they are read; for scenes
    that are stored by time and place see ``add_veg_index_stored``.
    """
    at = raster.with_pixel(points, meta)
    counts = counts or key_counts(at, CELL_DAY)
    need, n_need = counts[0].select(*CELL_DAY).where(F.col("date").isNotNull()), counts[1]
    first, last = need.agg(F.min("date"), F.max("date")).first()
    if first is not None:
        scenes = scenes.where((F.col("obs_date") >= F.date_sub(F.lit(first), window_days)) & (F.col("obs_date") < F.lit(last)))
    spanned = scenes.withColumn("span", F.floor(F.unix_date("obs_date") / window_days).cast("int"))
    used = lookup(spanned, _waiting(need, window_days), ["row", "col", "span"], "inner", right_rows=2 * n_need)
    used = used.withColumn("dates", F.filter("dates", _in_window(window_days))).where(F.size("dates") > 0)
    clear = clouds.where(F.col("cs_cdf") >= clear_sky).select("scene_id")
    used = lookup(used, clear, ["scene_id"], "inner")
    return lookup(at, _medians(used), CELL_DAY, counts=counts).drop("row", "col")


def add_veg_index_stored(
    points: DataFrame, store: SceneStore, meta: RasterMeta, clear_sky: float = CLEAR_SKY, counts: Counts | None = None
) -> DataFrame:
    """``add_veg_index`` with a window of the store's span, from stored scenes: only folders that a point looks at are read."""
    at = raster.with_pixel(points, meta)
    counts = counts or key_counts(at, CELL_DAY)
    need = counts[0].select(*CELL_DAY).where(F.col("date").isNotNull())
    waiting = settle(_waiting(need, store.span_days), "waiting")
    used = lookup(store.near(waiting, clear_sky), waiting, ["row", "col", "span"], "inner", right_rows=2 * counts[1])
    used = used.withColumn("dates", F.filter("dates", _in_window(store.span_days))).where(F.size("dates") > 0)
    return lookup(at, _medians(used), CELL_DAY, counts=counts).drop("row", "col")


def slope_percent(degrees: Column) -> Column:
    """Rise over run in percent; 0 where the slope is unknown."""
    return F.coalesce(F.tan(F.radians(degrees)) * 100, F.lit(0.0))


def add_terrain(points: DataFrame, dem: DataFrame, meta: RasterMeta, counts: Counts | None = None) -> DataFrame:
    at = raster.with_pixel(points, meta)
    counts = counts or key_counts(at, raster.PIXEL)
    terrain = raster.slope_from_dem(counts[0], dem, meta).select(
        *raster.PIXEL, F.col("elevation").alias("elevacion_centro"), F.col("slope_deg").alias("grados")
    )
    return (
        lookup(at, terrain, raster.PIXEL, counts=counts)
        .withColumn("porcentaje", slope_percent(F.col("grados")))
        .drop("row", "col")
    )


def add_land_cover(
    points: DataFrame, cover: DataFrame, legend: DataFrame, meta: RasterMeta, counts: Counts | None = None
) -> DataFrame:
    coded = raster.sample_filled(points, cover, meta, "_code", counts=counts)
    return raster.label(coded, legend, "_code", "vegetacion2").drop("_code")


def add_soil(points: DataFrame, soil_cells: DataFrame, meta: RasterMeta) -> DataFrame:
    return raster.sample(points, soil_cells, meta, "SOC")


def _chosen(points: DataFrame, limit: int | None, start, end, order: tuple) -> DataFrame:
    """``lat, lon, date`` of the points to extract."""
    named = {"lat_mean": "lat", "lon_mean": "lon", "date_first": "date"}
    for old, new in named.items():
        if old in points.columns and new not in points.columns:
            points = points.withColumnRenamed(old, new)
    text = dict(points.dtypes)["date"] == "string"
    points = points.withColumn("date", day_prefix(F.col("date")) if text else F.to_date("date"))
    chosen = clean.date_range(points, start, end)
    return clean.head(chosen, limit, *(order or ("date", "lat", "lon"))).select("lat", "lon", "date")


def weather(points, weather_daily, meta, limit: int | None = None, start=None, end=None, order: tuple = ()) -> DataFrame:
    return add_weather(_chosen(points, limit, start, end, order), weather_daily, meta)


def veg_index(points, scenes, clouds, meta, limit: int | None = None, start=None, end=None, order: tuple = ()) -> DataFrame:
    chosen = _chosen(points, limit, start, end, order)
    return add_veg_index(chosen, scenes, clouds, meta).select("NDVI", "NDWI", "lat", "lon", "date")


def terrain(points, dem, meta, limit: int | None = None, start=None, end=None, order: tuple = ()) -> DataFrame:
    return add_terrain(_chosen(points, limit, start, end, order), dem, meta)


def land_cover(points, cover, legend, meta, limit: int | None = None, start=None, end=None, order: tuple = ()) -> DataFrame:
    chosen = _chosen(points, limit, start, end, order)
    return add_land_cover(chosen, cover, legend, meta).select("vegetacion2", "lat", "lon", "date")


def soil(points, soil_cells, meta, limit: int | None = None, start=None, end=None, order: tuple = ()) -> DataFrame:
    chosen = _chosen(points, limit, start, end, order)
    return add_soil(chosen, soil_cells, meta).select("SOC", "lat", "lon", "date")
