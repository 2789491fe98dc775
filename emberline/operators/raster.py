"""Pixel lookups: a raster is a table of cells, a read is a join on (row, col)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import METRES_PER_DEGREE, RasterMeta, pixel_of
from emberline.operators.lineage import settle
from emberline.operators.skew import key_counts, lookup, shuffled

# Land-cover codes of water and urban areas, the last code of the legend, the label of no cover.
WATER_URBAN_COVER = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 33, 34, 36, 37, 38, 39, 40, 41, 42, 43)
MAX_COVER_CODE = 44
NO_COVER = "Sin datos"

# No wildfire starts on these, nor where the map has no data.
UNUSABLE_COVER = (*WATER_URBAN_COVER, MAX_COVER_CODE, -1)

PIXEL = ["row", "col"]


def with_pixel(points: DataFrame, meta: RasterMeta, lat: str = "lat", lon: str = "lon") -> DataFrame:
    row, col = pixel_of(F.col(lat), F.col(lon), meta)
    return points.withColumns({"row": row, "col": col})


def _valid(meta: RasterMeta) -> Column:
    return (F.col("value") >= 0) & (F.col("value") != F.lit(meta.nodata))


def _inside(meta: RasterMeta) -> Column:
    return F.col("row").between(0, meta.rows - 1) & F.col("col").between(0, meta.cols - 1)


def filled_pixels(
    need: DataFrame, raster: DataFrame, meta: RasterMeta, stat: str = "mode", window: int = 5, offset: int | None = None
) -> DataFrame:
    """``row, col, value`` of distinct pixels ``need``; invalid ones take a statistic of their neighbourhood.

    ``stat`` is ``mode`` (lowest value on ties; for class codes) or ``mean``. The window starts at ``offset``
    from the pixel, centred by default. Pixels without any valid neighbour are absent.
    """
    start = -(window // 2) if offset is None else offset
    centre = shuffled(need.where(_inside(meta)).select(*PIXEL)).join(raster.select(*PIXEL, "value"), PIXEL)
    steps = F.array(*[F.struct(F.lit(i).alias("r"), F.lit(j).alias("c")) for i in range(start, start + window) for j in range(start, start + window)])
    around = (
        centre.where(~_valid(meta))
        .select(F.col("row").alias("at_row"), F.col("col").alias("at_col"), F.explode(steps).alias("step"))
        .select("at_row", "at_col", (F.col("at_row") + F.col("step.r")).alias("row"), (F.col("at_col") + F.col("step.c")).alias("col"))
        .join(shuffled(raster.where(_valid(meta)).select(*PIXEL, "value")), PIXEL)
    )
    if stat == "mean":
        filled = around.groupBy("at_row", "at_col").agg(F.avg("value").alias("value"))
    elif stat == "mode":
        filled = (
            around.groupBy("at_row", "at_col", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("at_row", "at_col")
            .agg(F.max_by("value", F.struct(F.col("n"), -F.col("value"))).alias("value"))
        )
    else:
        raise ValueError(f"unknown statistic {stat!r}")
    return centre.where(_valid(meta)).unionByName(
        filled.select(F.col("at_row").alias("row"), F.col("at_col").alias("col"), "value")
    )


def sample(points: DataFrame, raster: DataFrame, meta: RasterMeta, name: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add the value of each point's pixel; NULL outside the grid and for nodata or negative values."""
    at = with_pixel(points, meta, lat, lon)
    valid = raster.where(_valid(meta)).select(*PIXEL, F.col("value").alias(name))
    return lookup(at, valid, PIXEL).drop(*PIXEL)


def sample_filled(
    points: DataFrame,
    raster: DataFrame,
    meta: RasterMeta,
    name: str,
    stat: str = "mode",
    window: int = 5,
    offset: int | None = None,
    lat: str = "lat",
    lon: str = "lon",
    counts: tuple[DataFrame, int, int] | None = None,
) -> DataFrame:
    """Like ``sample``, invalid pixels filled from their neighbourhood. Every pixel is worked out once."""
    at = with_pixel(points, meta, lat, lon)
    counts = counts or key_counts(at, PIXEL)
    # Written out: a union of tables dealt by one key counts as dealt by it, so the lookup joins it without an exchange; where exchanges are
    # reused it is not dealt so when it runs, and the join fails for unequal numbers of partitions.
    filled = settle(filled_pixels(counts[0], raster, meta, stat, window, offset), "filled")
    return lookup(at, filled.withColumnRenamed("value", name), PIXEL, counts=counts).drop(*PIXEL)


def label(points: DataFrame, legend: DataFrame, code: str, name: str) -> DataFrame:
    """Add the label of a class code; NULL, fractional and out-of-range codes have none.

    Only codes 0 to 44 are used, one row each, so the broadcast is at most 45 rows.
    """
    known = (
        legend.where(F.col("code").between(0, MAX_COVER_CODE))
        .groupBy("code")
        .agg(F.min("label").alias(name))
        .select(F.col("code").cast("double").alias(code), name)
    )
    named = points.withColumn(code, F.col(code).cast("double")).join(F.broadcast(known), code, "left")
    return named.withColumn(name, F.coalesce(name, F.lit(NO_COVER)))


def is_unusable(code: Column) -> Column:
    """Water, urban, no data, or a code that stayed unknown or negative."""
    return code.isNull() | (code < 0) | code.isin(*[float(c) for c in UNUSABLE_COVER])


def slope_from_dem(need: DataFrame, dem: DataFrame, meta: RasterMeta) -> DataFrame:
    """``row, col, elevation, slope_deg`` of distinct pixels ``need``.

    Gradient over the four neighbours in metres; slope is NULL where one of them is missing.
    """
    arms = F.array(
        *[
            F.struct(F.lit(a).alias("arm"), F.lit(r).alias("r"), F.lit(c).alias("c"))
            for a, r, c in (("o", 0, 0), ("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1))
        ]
    )
    heights = dem.where(F.col("value") != F.lit(meta.nodata)).select(*PIXEL, "value")
    cross = (
        need.where(_inside(meta))
        .select(F.col("row").alias("at_row"), F.col("col").alias("at_col"), F.explode(arms).alias("a"))
        .select("at_row", "at_col", "a.arm", (F.col("at_row") + F.col("a.r")).alias("row"), (F.col("at_col") + F.col("a.c")).alias("col"))
        .join(shuffled(heights), PIXEL)
        .groupBy("at_row", "at_col")
        .agg(*[F.max(F.when(F.col("arm") == a, F.col("value"))).alias(a) for a in "onswe"])
        .where(F.col("o").isNotNull())
    )
    mid_lat = F.lit(meta.y0) - (F.col("at_row") + 0.5) * meta.dy
    gx = (F.col("e") - F.col("w")) / (F.cos(F.radians(mid_lat)) * (2 * meta.dx * METRES_PER_DEGREE))
    gy = (F.col("n") - F.col("s")) / (2 * meta.dy * METRES_PER_DEGREE)
    return cross.select(
        F.col("at_row").alias("row"),
        F.col("at_col").alias("col"),
        F.col("o").alias("elevation"),
        F.degrees(F.atan(F.hypot(gx, gy))).alias("slope_deg"),
    )
