"""Regions: polygons as a table of edges, so that no geometry is ever held whole.

``edges``: ``region, part, x1, y1, x2, y2`` in lon/lat. A region is the union of its parts; a part is a
polygon whose rings (shell and holes, wound in opposite directions) count by the even-odd rule.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import point_in_edges, ring_edges, to_3035
from emberline.operators.lineage import settle
from emberline.operators.skew import lookup

CLAMP = {"min_x": -10.0, "max_x": 30.0, "min_y": 35.0, "max_y": 71.0}
EDGES_PER_BAND = 256


def edges_from_rings(rings: DataFrame, key: str = "region") -> DataFrame:
    """Edges of a table with one ``ring`` per row."""
    e = rings.select(F.col(key).alias("region"), "part", F.explode(ring_edges(F.col("ring"))).alias("e"))
    return e.select(
        "region",
        "part",
        F.col("e.a.x").alias("x1"),
        F.col("e.a.y").alias("y1"),
        F.col("e.b.x").alias("x2"),
        F.col("e.b.y").alias("y2"),
    )


def edges_from_vertices(vertices: DataFrame, key: str = "region") -> DataFrame:
    """Edges of a table with one vertex per row, ``seq`` running 0, 1, 2, ... along each open ring."""
    v = vertices.select(
        F.col(key).alias("region"), F.col("part") if "part" in vertices.columns else F.lit(0).alias("part"), "seq", "x", "y"
    )
    last = v.groupBy("region", "part").agg(F.max("seq").alias("last"))
    start = v.join(last, ["region", "part"]).withColumn(
        "seq", F.when(F.col("seq") == F.col("last"), 0).otherwise(F.col("seq") + 1)
    )
    end = v.select("region", "part", "seq", F.col("x").alias("x2"), F.col("y").alias("y2"))
    return start.join(end, ["region", "part", "seq"]).select(
        "region", "part", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2"
    )


def mask_name(c: Column) -> Column:
    """Name under which a region's mask is stored."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "Bio-geographical", ""), " ", ""))


def dissolve(edges: DataFrame, zone: Column, where: Column | None = None) -> DataFrame:
    """Union of regions under a new name: their parts side by side; inner borders are kept but have no effect."""
    kept = edges if where is None else edges.where(where)
    part = F.concat_ws("/", F.col("region").cast("string"), F.col("part").cast("string"))
    return kept.select(zone.alias("_zone"), part.alias("part"), "x1", "y1", "x2", "y2").withColumnRenamed("_zone", "region")


def _band_index(edges: DataFrame) -> tuple[DataFrame, float, int, int]:
    """One row per latitude band with the edges that cross it; band height, bands, mean edges per band.

    The bands are the finer the more edges there are, so that a point meets some hundred edges at most.
    """
    slanted = edges.where("y1 <> y2")
    n, low, high = slanted.agg(F.count(F.lit(1)), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    height = min(0.25, max(0.001, (high - low) * EDGES_PER_BAND / n)) if n else 0.25
    band = lambda y: F.floor(y / height).cast("int")
    cut = slanted.withColumn(
        "band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2"))))
    )
    per_part = cut.groupBy("band", "region", "part").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"),
        F.min(F.least("x1", "x2")).alias("x0"),
        F.max(F.greatest("x1", "x2")).alias("x1"),
    )
    index = settle(
        per_part.groupBy("band").agg(
            F.collect_list(F.struct("region", "part", "x0", "x1", "edges")).alias("parts"),
            F.sum(F.size("edges")).alias("n_edges"),
        ),
        "bands",
    )
    bands, entries = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_edges"), F.lit(0))).first()
    return index.drop("n_edges"), height, bands, math.ceil(entries / max(bands, 1))


def assign_region(points: DataFrame, edges: DataFrame, lat: str = "lat_mean", lon: str = "lon_mean") -> DataFrame:
    """``points`` with the ``region`` that holds them: a row per region, none for points outside all.

    An equi-join on the latitude band brings each point only the edges its own ray may cross.
    """
    index, height, bands, weight = _band_index(edges)
    banded = points.withColumn("band", F.floor(F.col(lat) / height).cast("int"))
    met = lookup(banded, index, ["band"], "inner", right_rows=bands, weight=max(weight, 1))
    x, y = F.col(lon), F.col(lat)
    inside = lambda p: (x >= p["x0"]) & (x <= p["x1"]) & point_in_edges(x, y, p["edges"])
    names = F.array_distinct(F.transform(F.filter("parts", inside), lambda p: p["region"]))
    return met.withColumn("region", F.explode(names)).drop("band", "parts")


def region_area(edges: DataFrame) -> DataFrame:
    """``region, area_km2`` in equal-area metres; holes count negative."""
    xa, ya = to_3035(F.col("x1"), F.col("y1"))
    xb, yb = to_3035(F.col("x2"), F.col("y2"))
    # Relative to the projection's origin of the false grid, to keep the products small.
    xa, xb, ya, yb = xa - 4321000.0, xb - 4321000.0, ya - 3210000.0, yb - 3210000.0
    parts = edges.groupBy("region", "part").agg((F.abs(F.sum(xa * yb - xb * ya)) / 2e6).alias("km2"))
    return parts.groupBy("region").agg(F.sum("km2").alias("area_km2"))


def region_bbox(edges: DataFrame, clamp: dict[str, float] | None = CLAMP) -> DataFrame:
    """Bounding box per region, cut to the study area; NULL-free but possibly inverted (then it is empty)."""
    box = edges.groupBy("region").agg(
        F.min("x1").alias("min_x"), F.max("x1").alias("max_x"), F.min("y1").alias("min_y"), F.max("y1").alias("max_y")
    )
    if clamp is None:
        return box
    return box.select(
        "region",
        F.greatest("min_x", F.lit(clamp["min_x"])).alias("min_x"),
        F.least("max_x", F.lit(clamp["max_x"])).alias("max_x"),
        F.greatest("min_y", F.lit(clamp["min_y"])).alias("min_y"),
        F.least("max_y", F.lit(clamp["max_y"])).alias("max_y"),
    )


def region_stats(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """``region, fires, frp_total`` for every region, zeros where nothing burned."""
    per_region = assigned.groupBy("region").agg(
        F.count(F.lit(1)).alias("fires"), F.sum(F.col("frp_mean").cast("decimal(28,10)")).cast("double").alias("frp_total")
    )
    return (
        edges.select("region")
        .distinct()
        .join(per_region, "region", "left")
        .select("region", F.coalesce("fires", F.lit(0)).alias("fires"), F.coalesce("frp_total", F.lit(0.0)).alias("frp_total"))
    )
