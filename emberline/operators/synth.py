"""Synthetic non-fire points: near fires in proportion to their power, and at random for the rest.

Every draw is a hash of the point's identity, so the same seed gives the same points on any cluster.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.dates import clamped_date
from emberline.functions.geo import RasterMeta, destination
from emberline.functions.rounding import to_count
from emberline.functions.uniform import digest, draw_between, draw_int
from emberline.operators import raster, zones
from emberline.operators.lineage import settle
from emberline.operators.skew import few, lookup, repeat_rows, shuffled

PER_FIRE = 30
ALPHA = 0.5
ATTEMPTS = 3
NEAREST_M, FARTHEST_M = 5000.0, 10000.0


def quotas(assigned: DataFrame, edges: DataFrame, n_fires: int, per_fire: int = PER_FIRE, alpha: float = ALPHA) -> DataFrame:
    """``region, fires, frp_total, area_km2, quota``; the fire share counts all fires, also those in no region."""
    stats = zones.region_stats(assigned, edges).join(zones.region_area(edges), "region")
    stats = settle(stats, "region-stats")
    area = stats.agg(F.sum("area_km2")).first()[0] or 0.0
    by_fires = F.col("fires") / F.lit(float(n_fires)) if n_fires else F.lit(0.0)
    by_area = F.col("area_km2") / F.lit(area) if area else F.lit(0.0)
    share = by_fires * alpha + by_area * (1 - alpha)
    return stats.withColumn("quota", to_count(share * float(n_fires * per_fire)))


def near_counts(assigned: DataFrame, quota: DataFrame, n_regions: int) -> DataFrame:
    """``n_near`` points around each fire: its share of the region's power; none where there is no power."""
    met = lookup(assigned, quota.select("region", "frp_total", "quota"), ["region"], "inner", right_rows=n_regions)
    share = F.col("frp_mean") / F.when(F.col("frp_total") > 0, F.col("frp_total"))
    return met.withColumn("n_near", F.coalesce(to_count(share * F.col("quota")), F.lit(0)))


def spread_over_year(plan: DataFrame) -> DataFrame:
    """One row per (fire, month) with ``n`` points: even, the rest to the first months, one less in the fire's own."""
    month = F.col("month")
    base = F.floor(F.col("n_near") / 12).cast("long")
    extra = (month <= F.col("n_near") - base * 12).cast("long")
    own = (month == F.month("date_first")).cast("long")
    return (
        plan.where("n_near > 0")
        .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
        .withColumn("n", F.greatest(F.lit(0).cast("long"), base + extra - own))
    )


def near_candidates(months: DataFrame, seed: int, total: int = 0, compat_degrees: bool = False) -> DataFrame:
    """The points around fires, before any check: 5 to 10 km away in any direction."""
    rows = repeat_rows(
        months.select("region", "fire_id", "lat_mean", "lon_mean", "date_first", "month", "n"), "n", "i", total
    )
    rows = rows.withColumn("_d", digest(seed, "near", F.col("fire_id"), F.col("region"), F.col("month"), F.col("i")))
    lat, lon = destination(
        F.col("lat_mean"),
        F.col("lon_mean"),
        draw_between(F.col("_d"), 0, F.lit(NEAREST_M), F.lit(FARTHEST_M)),
        draw_between(F.col("_d"), 1, F.lit(0.0), F.lit(360.0)),
        compat_degrees,
    )
    return rows.select(
        F.concat_ws(":", F.lit("near"), "region", "fire_id", "month", "i").alias("point_id"),
        "region",
        F.lit("near").alias("source"),
        lat.alias("lat"),
        lon.alias("lon"),
        clamped_date(F.year("date_first"), F.col("month"), F.dayofmonth("date_first")).alias("date"),
    )


def _on_fire(points: DataFrame, fires: DataFrame, n_fires: int) -> DataFrame:
    """Mark points that have exactly a fire's coordinates. Drawn coordinates hardly repeat: no skew here."""
    places = fires.select(F.col("lat_mean").alias("lat"), F.col("lon_mean").alias("lon")).distinct()
    places = places.withColumn("_fire", F.lit(True))
    places = F.broadcast(places) if few(places, n_fires) else shuffled(places)
    return points.join(places, ["lat", "lon"], "left").withColumn("_fire", F.coalesce("_fire", F.lit(False)))


def not_a_fire(points: DataFrame, fires: DataFrame) -> DataFrame:
    """Points whose coordinates are no fire's."""
    places = fires.select(F.col("lat_mean").alias("lat"), F.col("lon_mean").alias("lon"), F.lit(True).alias("_fire"))
    return lookup(points, places.distinct(), ["lat", "lon"]).where("_fire IS NULL").drop("_fire")


def on_usable_land(points: DataFrame, cover: DataFrame, meta: RasterMeta) -> DataFrame:
    """Add ``usable``: neither water, urban, nor without land cover."""
    coded = raster.sample_filled(points, cover, meta, "_code")
    return coded.withColumn("usable", ~raster.is_unusable(F.col("_code"))).drop("_code")


def checked(points: DataFrame, fires: DataFrame, n_fires: int, cover: DataFrame, meta: RasterMeta) -> DataFrame:
    """Add ``valid``: usable land and not the place of a fire."""
    marked = _on_fire(on_usable_land(points, cover, meta), fires, n_fires)
    return marked.withColumn("valid", F.col("usable") & ~F.col("_fire")).drop("usable", "_fire")


def random_plan(quota: DataFrame, near: DataFrame, checked_near: DataFrame, edges: DataFrame) -> DataFrame:
    """``region`` box and ``n`` points per month: what the quota leaves over, up to the next multiple of 12."""
    planned = near.groupBy("region").agg(F.sum("n_near").alias("planned"))
    rejected = checked_near.where("NOT valid").groupBy("region").agg(F.count(F.lit(1)).alias("rejected"))
    zero = F.lit(0).cast("long")
    rest = (
        quota.select("region", "quota")
        .join(planned, "region", "left")
        .join(rejected, "region", "left")
        .withColumn("rest", F.col("quota") - F.coalesce("planned", zero) + F.coalesce("rejected", zero))
        .where("rest > 0")
    )
    return (
        rest.join(zones.region_bbox(edges), "region")
        .where("min_x <= max_x AND min_y <= max_y")
        .withColumn("n", F.ceil(F.col("rest") / 12).cast("long"))
    )


def random_candidates(plan: DataFrame, seed: int, year: int, total: int = 0) -> DataFrame:
    """Three attempts, as rows, for every random point of a region's box."""
    months = plan.select("region", "min_x", "max_x", "min_y", "max_y", "n").withColumn(
        "month", F.explode(F.sequence(F.lit(1), F.lit(12)))
    )
    rows = repeat_rows(months, "n", "i", total).withColumn(
        "attempt", F.explode(F.sequence(F.lit(1), F.lit(ATTEMPTS)))
    )
    key: list[Column | str] = ["random", F.col("region"), F.col("month"), F.col("i"), F.col("attempt")]
    rows = rows.withColumn("_d", digest(seed, *key))
    return rows.select(
        F.concat_ws(":", F.lit("random"), "region", "month", "i").alias("point_id"),
        "region",
        F.lit("random").alias("source"),
        "attempt",
        draw_between(F.col("_d"), 0, F.col("min_y"), F.col("max_y")).alias("lat"),
        draw_between(F.col("_d"), 1, F.col("min_x"), F.col("max_x")).alias("lon"),
        F.make_date(F.lit(year), F.col("month"), draw_int(F.col("_d"), 2, 1, 28)).alias("date"),
    )


def first_valid(attempts: DataFrame) -> DataFrame:
    """The first valid attempt of each point; points without any are gone."""
    chosen = [F.min_by(c, "attempt").alias(c) for c in ("lat", "lon", "date")]
    return attempts.where("valid").groupBy("point_id", "region", "source").agg(*chosen)


def first_year(fires: DataFrame) -> int:
    """Year of the first fire of the list, which is ordered by size."""
    return fires.agg(F.min_by(F.year("date_first"), F.struct(-F.col("count"), F.col("fire_id")))).first()[0]


def synthetic_points(
    fires: DataFrame,
    edges: DataFrame,
    cover: DataFrame,
    meta: RasterMeta,
    seed: int = 42,
    per_fire: int = PER_FIRE,
    alpha: float = ALPHA,
    year: int | None = None,
    inside: bool = False,
    compat_degrees: bool = False,
) -> DataFrame:
    """``point_id, region, source, lat, lon, date``: about ``per_fire`` points per fire.

    Random points fill a region's box; with ``inside`` they must lie in the region itself.
    """
    fires = settle(fires.select("fire_id", "lat_mean", "lon_mean", "frp_mean", "date_first", "count"), "fires")
    n_fires = fires.count()
    assigned = settle(zones.assign_region(fires, edges), "assigned")
    quota = settle(quotas(assigned, edges, n_fires, per_fire, alpha), "quotas")
    n_regions = quota.count()
    total = n_fires * per_fire
    near = settle(near_counts(assigned, quota, n_regions), "near-plan")
    candidates = near_candidates(spread_over_year(near), seed, total, compat_degrees)
    near_points = settle(checked(candidates, fires, n_fires, cover, meta), "near")

    plan = settle(random_plan(quota, near, near_points, edges), "random-plan")
    if plan.isEmpty():
        return near_points.where("valid").drop("valid")
    attempts = random_candidates(plan, seed, year or first_year(fires), total * ATTEMPTS)
    if inside:
        home = attempts.withColumnRenamed("region", "home")
        attempts = zones.assign_region(home, edges, "lat", "lon").where("region = home").drop("home")
    random_points = first_valid(checked(attempts, fires, n_fires, cover, meta))
    columns = ["point_id", "region", "source", "lat", "lon", "date"]
    return near_points.where("valid").select(*columns).unionByName(random_points.select(*columns))
