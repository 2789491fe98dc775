"""The entry points: whole jobs composed of the operators."""

from collections.abc import Sequence
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.dates import day_prefix
from emberline.functions.geo import RasterMeta
from emberline.operators import clean, enrich, events, merge, nulls, quality, summary, synth
from emberline.operators.lineage import settle
from emberline.operators.skew import skew_join
from emberline.sources import tables

KEY = ("lat", "lon", "date")
FIRE_NAMES = {"lat": "lat_mean", "lon": "lon_mean", "date": "date_first"}


def fetch_fires(
    hotspots: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    dist_km: float = 5.0,
    gap_days: int = 6,
    res_m: float = 375.0,
    order: str = "date",
) -> DataFrame:
    """Raw detections to fire events, largest first; empty if nothing is left in the date range.

    ``order`` is the order in which a cluster is walked for gaps: ``date``, or ``input`` for the source's own.
    """
    usable = clean.date_range(clean.clean_hotspots(hotspots), start, end)
    if order == "input":
        points = settle(events.fire_points_in_input_order(usable, dist_km, gap_days), "fire-points")
        return events.largest_first(events.fires_in_input_order(points, res_m))
    if order != "date":
        raise ValueError(f"unknown order {order!r}")
    return events.largest_first(events.separate_fire_events(usable, dist_km, gap_days).fires(res_m))


def label_union(fires: DataFrame, non_fires: DataFrame) -> DataFrame:
    """Fires (``final`` 1) and non-fires (0) in one table; columns only one side has are NULL on the other."""
    for old, new in FIRE_NAMES.items():
        if old in non_fires.columns:
            non_fires = non_fires.withColumnRenamed(old, new)
    return fires.withColumn("final", F.lit(1)).unionByName(
        non_fires.withColumn("final", F.lit(0)), allowMissingColumns=True
    )


def label_union_by_year(
    spark: SparkSession, root: str, fires: str, non_fires: str, target: str, years: Sequence[int] | None = None
) -> None:
    """Label the topics ``fires`` and ``non_fires`` and store their union as topic ``target``, year by year.

    Both topics are partitioned by year, so years pair by value and only the chosen ones are read.
    """
    sides = [tables.read_topic(spark, root, topic, years).drop("year") for topic in (fires, non_fires)]
    tables.write_label_union(label_union(*sides), f"{root}/{target}")


def build_environment(
    hotspots: DataFrame,
    edges: DataFrame,
    cover: DataFrame,
    legend: DataFrame,
    weather_daily: DataFrame,
    scenes: DataFrame,
    clouds: DataFrame,
    dem: DataFrame,
    meta: RasterMeta,
    limit: int | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
    seed: int = 42,
    weather_meta: RasterMeta | None = None,
    scenes_meta: RasterMeta | None = None,
    dem_meta: RasterMeta | None = None,
) -> DataFrame:
    """Fires and synthetic non-fires with land cover, weather, vegetation and terrain.

    ``meta`` is the land cover's grid and nodata value; every other raster may have its own.
    A limit takes fires before non-fires, the largest first, before anything is looked up.
    """
    fires = settle(fetch_fires(hotspots, start, end), "fires")
    if fires.isEmpty():
        raise ValueError("no fires in the chosen range")
    others = synth.synthetic_points(fires, edges, cover, meta, seed).drop("region", "source")
    merged = label_union(fires.withColumn("point_id", F.concat_ws(":", F.lit("fire"), "fire_id")), others)
    chosen = clean.head(merged, limit, F.desc("final"), F.desc_nulls_last("count"), "point_id")
    at = chosen.withColumns({new: F.col(old) for new, old in FIRE_NAMES.items()})
    points = settle(at, "points")
    weather_meta, scenes_meta, dem_meta = weather_meta or meta, scenes_meta or meta, dem_meta or meta
    days, cells = enrich.cell_days(points, weather_meta), enrich.cells(points, meta)
    scene_days = days if _same_grid(scenes_meta, weather_meta) else enrich.cell_days(points, scenes_meta)
    dem_cells = cells if _same_grid(dem_meta, meta) else enrich.cells(points, dem_meta)
    points = enrich.add_weather(points, weather_daily, weather_meta, days)
    points = enrich.add_veg_index(points, scenes, clouds, scenes_meta, counts=scene_days)
    points = enrich.add_terrain(points, dem, dem_meta, dem_cells)
    points = enrich.add_land_cover(points, cover, legend, meta, cells)
    return points.select("vegetacion2", *[c for c in points.columns if c != "vegetacion2"])


def _same_grid(a: RasterMeta, b: RasterMeta) -> bool:
    return replace(a, nodata=b.nodata) == b


def _dated(tables: Sequence[DataFrame]) -> list[DataFrame]:
    """Dates brought to whole days. A text that is no date stops the job: as a NULL it would meet every other such row of its place."""
    if len(tables) < 2:
        raise ValueError("at least two tables are needed")
    return [quality.normalise_date(t, strict=True) for t in tables]


def merge_features(tables: Sequence[DataFrame]) -> DataFrame:
    """Left-join feature tables to the first one on (lat, lon, date), dates brought to whole days."""
    return merge.merge(_dated(tables), KEY)


def store_features(spark: SparkSession, tables: dict[str, DataFrame], root: str, buckets: int | None = None) -> None:
    """Store feature tables so that ``merge_stored`` joins them without a shuffle, as often as it is asked.

    All of them get the same number of ``buckets`` (as many as the session's shuffle partitions, if not given).
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, df in tables.items():
        merge.store_bucketed(quality.normalise_date(df, strict=True), KEY, name, f"{root}/{name}", buckets)


def merge_stored(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """``merge_features`` of stored tables, in place: none of them is moved."""
    if len(names) < 2:
        raise ValueError("at least two tables are needed")
    return merge.merge_keyed(merge.read_bucketed(spark, names), KEY)


def _by_day(df: DataFrame) -> DataFrame:
    text = dict(df.dtypes)["date"] == "string"
    return df.withColumn("date", day_prefix(F.col("date")) if text else F.to_date("date"))


def _label_keys(labels: DataFrame) -> DataFrame:
    for old, new in FIRE_NAMES.items():
        if new in labels.columns:
            labels = labels.drop(old).withColumnRenamed(new, old)
    return _by_day(labels.select(*KEY, "final"))


def feature_join(labels: DataFrame, feature: DataFrame) -> DataFrame:
    """``lat, lon, date, final`` of the labelled points with one feature table, matching rows only."""
    return skew_join(_label_keys(labels), _by_day(feature), KEY, "inner")


def null_audit(labels: DataFrame, features: dict[str, DataFrame]) -> nulls.NullAudit:
    """Where feature tables lack values at the labelled points: by column, month, burned area and feature."""
    for old, new in FIRE_NAMES.items():
        if new in labels.columns:
            labels = labels.drop(old).withColumnRenamed(new, old)
    return nulls.NullAudit(_by_day(labels), {name: _by_day(df) for name, df in features.items()}, KEY)


def audit(labels: DataFrame, features: dict[str, DataFrame]) -> DataFrame:
    """Nulls per feature table, class and column."""
    return null_audit(labels, features).by_column()


def clean_cover(df: DataFrame, legend: DataFrame) -> DataFrame:
    """Without points of unknown, water or urban land cover."""
    return quality.drop_water_urban(quality.drop_unusable_cover(df), legend)


def profile(df: DataFrame, preview: int = 10, order: Sequence[str] = KEY) -> dict[str, DataFrame]:
    """First rows, completeness, numeric statistics, value shares and distinct counts of a final table, in two scans and the one for the first rows."""
    found = summary.summarise(df)
    return {
        "head": clean.head(df, preview, *order),
        "completeness": summary.completeness(found, df),
        "describe": found.stats,
        "value_shares": summary.value_shares(found),
        "n_unique": summary.n_unique(found),
    }
