"""From clustered detections to fire events.

Everything an event needs is first added up per (cell, day, rounded longitude), a *tile*. A fire that holds
a third of all detections is then just a few thousand tiles: days and the 0.01 degree grid bound their number.
"""

import sys
from dataclasses import dataclass
from datetime import date

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.geo import buffered_area, to_6933
from emberline.functions.rounding import grid_units, np_round, py_round
from emberline.operators import cluster
from emberline.operators.lineage import settle
from emberline.operators.skew import LONG_BYTES, lookup, shuffled

SEED_DATE = date(2020, 1, 1)
ROUND_DECIMALS = 2
UNIT = float(10**ROUND_DECIMALS)
EXACT = "decimal(20,6)"


def tiles(points: DataFrame, keys: list[str]) -> DataFrame:
    """Additive summary per ``keys`` and rounded longitude: all later steps start from these few rows."""
    lat, lon = grid_units(F.col("lat"), ROUND_DECIMALS), grid_units(F.col("lon"), ROUND_DECIMALS)
    return (
        points.withColumns({"_lat": lat, "lon_u": lon})
        .groupBy(*keys, "lon_u")
        .agg(
            F.min("_lat").alias("lat_lo"),
            F.max("_lat").alias("lat_hi"),
            F.sum("_lat").alias("lat_sum"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("frp").cast(EXACT)).alias("frp"),
            F.min("ord").alias("first_ord"),
        )
    )


def merge_tiles(t: DataFrame, keys: list[str]) -> DataFrame:
    """Add tiles up to coarser ``keys``, the rounded longitude kept."""
    return t.groupBy(*keys, "lon_u").agg(
        F.min("lat_lo").alias("lat_lo"),
        F.max("lat_hi").alias("lat_hi"),
        F.sum("lat_sum").alias("lat_sum"),
        F.sum("n").alias("n"),
        F.sum("frp").cast("decimal(30,6)").alias("frp"),
        F.min("first_ord").alias("first_ord"),
        *([] if "date" in keys else [F.min("date").alias("date_lo"), F.max("date").alias("date_hi")]),
    )


def split_by_gap(days: DataFrame, max_gap_days: int = 6, seed_date: date = SEED_DATE) -> DataFrame:
    """Give each (component, date) its place in the component's chain of fires.

    In (date, order) order a new fire can only open at the first detection of a day, so it is enough to walk
    the distinct days of a component. A gap is counted from the previous day, for the first one from
    ``seed_date``. Adds ``split`` and ``seq``.
    """
    w = Window.partitionBy("component").orderBy("date")
    previous = F.coalesce(F.lag("date").over(w), F.lit(seed_date))
    return days.withColumn("split", F.datediff("date", previous) > max_gap_days).withColumn(
        "seq", F.sum(F.col("split").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )


def chained_id(days: DataFrame) -> DataFrame:
    """Add ``fire_id``: the cluster number and the order numbers of all splits so far, joined by ``_``."""
    w = Window.partitionBy("component").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.collect_list(F.when(F.col("split"), F.col("first_ord").cast("string"))).over(w)
    return days.withColumn("fire_id", F.concat_ws("_", F.col("label").cast("string"), opened))


# Ship the hull code with the job: workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_HULL = T.StructType([T.StructField("area", T.DoubleType()), T.StructField("perimeter", T.DoubleType())])


def _chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """One side of the convex hull of points sorted along x."""
    out: list[tuple[float, float]] = []
    for x, y in points:
        while len(out) > 1:
            (ax, ay), (bx, by) = out[-2], out[-1]
            if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                break
            out.pop()
        out.append((x, y))
    return out


def hull_measure(points: set[tuple[float, float]]) -> tuple[float, float]:
    """Area and perimeter of the convex hull; a segment counts there and back, a point not at all."""
    order = sorted(points)
    if len(order) < 2:
        return 0.0, 0.0
    ring = _chain(order)[:-1] + _chain(order[::-1])[:-1]
    x, y = (np.array(c) for c in zip(*ring))
    x, y = x - x[0], y - y[0]
    nx, ny = np.roll(x, -1), np.roll(y, -1)
    return float(abs(np.sum(x * ny - nx * y)) / 2), float(np.sum(np.hypot(nx - x, ny - y)))


@F.pandas_udf(_HULL)
def _hull(xs: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
    """Hulls of fires given as lowest and highest y per x."""
    rows = [hull_measure({*zip(x, lo), *zip(x, hi)}) for x, lo, hi in zip(xs, lows, highs)]
    return pd.DataFrame(rows, columns=["area", "perimeter"])


def _with_area(fires: DataFrame, res_m: float) -> DataFrame:
    """Replace ``slices`` (one per rounded longitude) and ``count`` by ``area_ha``."""
    many = F.col("count") >= 3
    fires = fires.withColumn("slices", F.when(many, F.col("slices")).otherwise(F.slice("slices", 1, 0)))
    hull = _hull(
        F.transform("slices", lambda s: to_6933(s["lon_u"] / UNIT, s["lat_lo"] / UNIT)[0]),
        F.transform("slices", lambda s: to_6933(s["lon_u"] / UNIT, s["lat_lo"] / UNIT)[1]),
        F.transform("slices", lambda s: to_6933(s["lon_u"] / UNIT, s["lat_hi"] / UNIT)[1]),
    )
    grown = buffered_area(F.col("hull.area"), F.col("hull.perimeter"), res_m / 2)
    square_metres = F.when(many, grown).otherwise(F.col("count") * float(res_m) ** 2)
    return fires.withColumn("hull", hull).withColumn("area_ha", py_round(square_metres / 10000)).drop("hull", "slices")


def _slices() -> Column:
    return F.collect_list(F.struct("lon_u", "lat_lo", "lat_hi")).alias("slices")


def fire_area(points: DataFrame, res_m: float = 1000.0) -> DataFrame:
    """``fire_id, area_ha`` of points with a ``fire_id``: hull of the rounded places grown by half a pixel.

    Fires of one or two detections count a pixel each. Per rounded longitude only the extreme latitudes can
    be on the hull, so a hull task sees at most 36,001 pairs of points, however large the fire.
    """
    lat, lon = grid_units(F.col("lat"), ROUND_DECIMALS), grid_units(F.col("lon"), ROUND_DECIMALS)
    per_lon = (
        points.withColumns({"_lat": lat, "lon_u": lon})
        .groupBy("fire_id", "lon_u")
        .agg(F.min("_lat").alias("lat_lo"), F.max("_lat").alias("lat_hi"), F.count(F.lit(1)).alias("n"))
    )
    fires = per_lon.groupBy("fire_id").agg(F.sum("n").alias("count"), _slices())
    return _with_area(fires, res_m).select("fire_id", "area_ha")


def _summary_columns() -> list[Column]:
    mean = lambda c: F.col(c).cast("double") / F.col("count") / UNIT
    return [
        F.col("fire_id"),
        mean("lat_sum").alias("lat_mean"),
        mean("lon_sum").alias("lon_mean"),
        F.col("frp").cast("double").alias("frp_sum"),
        (F.col("frp").cast("double") / F.col("count")).alias("frp_mean"),
        F.col("count"),
        F.col("date_first"),
        F.col("date_last"),
        (F.datediff("date_last", "date_first") + 1).alias("duration_days"),
    ]


def _summary(per_lon: DataFrame) -> DataFrame:
    """One row per fire from its tiles (``date_lo``/``date_hi`` already merged)."""
    return per_lon.groupBy("fire_id").agg(
        F.sum("lat_sum").alias("lat_sum"),
        F.sum(F.col("lon_u") * F.col("n")).alias("lon_sum"),
        F.sum("frp").alias("frp"),
        F.sum("n").alias("count"),
        F.min("date_lo").alias("date_first"),
        F.max("date_hi").alias("date_last"),
        _slices(),
    )


def fire_summary(points: DataFrame) -> DataFrame:
    """Centroid, power, size and dates per ``fire_id``; coordinates are rounded to 0.01 degree first."""
    per_lon = merge_tiles(tiles(points, ["fire_id", "date"]), ["fire_id"])
    return _summary(per_lon).select(*_summary_columns())


@dataclass(frozen=True)
class FireSplit:
    """``tiles`` with ``fire_id`` per (component, day, longitude) and ``days`` with the chain of fires."""

    points: DataFrame
    cell_tiles: DataFrame
    components: DataFrame
    days: DataFrame
    tiles: DataFrame

    def fires(self, res_m: float = 375.0) -> DataFrame:
        """One row per fire, area included."""
        fires = _summary(merge_tiles(self.tiles, ["fire_id"]))
        return _with_area(fires, res_m).select(*_summary_columns(), "area_ha")

    def labelled_points(self) -> DataFrame:
        """The detections with their ``fire_id``, coordinates rounded as the summary sees them."""
        keys = ["cell", "date"]
        per_day = self.cell_tiles.groupBy(*keys).agg(F.sum("n").alias("_rows"))
        ids = (
            shuffled(per_day.select(*keys))
            .join(self.components, "cell")
            .join(shuffled(self.days.select("component", "date", "fire_id")), ["component", "date"])
            .select(*keys, "fire_id")
        )
        ids = settle(ids, "cell-days")
        n_ids, weight = _sized(ids)
        named = lookup(self.points, ids, keys, "inner", right_rows=n_ids, counts=_counted(per_day), weight=weight)
        return named.select(
            "ord",
            np_round(F.col("lat"), ROUND_DECIMALS).alias("lat"),
            np_round(F.col("lon"), ROUND_DECIMALS).alias("lon"),
            "frp",
            "date",
            "fire_id",
        )


def _counted(counts: DataFrame) -> tuple[DataFrame, int, int]:
    n_keys, n_rows = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    return counts, n_keys, n_rows


def _sized(ids: DataFrame) -> tuple[int, int]:
    """Number of rows, and how many times longer than an ordinary text their ``fire_id``s are: they chain all earlier splits."""
    n, size = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("fire_id")), F.lit(0))).first()
    return n, 1 + size // max(n, 1) // LONG_BYTES


def separate_fire_events(
    clean: DataFrame, dist_km: float = 2.0, max_gap_days: int = 6, seed_date: date = SEED_DATE
) -> FireSplit:
    """Cluster cleaned detections in space and split the clusters in time."""
    points = settle(cluster.with_cell(clean, dist_km), "points")
    components = cluster.components(points, dist_km)
    cell_tiles = tiles(points, ["cell", "date"])
    part_tiles = settle(merge_tiles(shuffled(cell_tiles).join(components, "cell"), ["component", "date"]), "component-tiles")
    days = part_tiles.groupBy("component", "date").agg(F.min("first_ord").alias("first_ord"))
    first = settle(days.groupBy("component").agg(F.min("first_ord").alias("first_ord")), "first")
    numbered = cluster.label(first).select("component", "label")
    days = chained_id(shuffled(split_by_gap(days, max_gap_days, seed_date)).join(numbered, "component"))
    named = shuffled(part_tiles).join(days.select("component", "date", "seq", "fire_id"), ["component", "date"])
    return FireSplit(points, cell_tiles, components, days, named)


ORD_BLOCK = 65_536


def split_in_input_order(
    points: DataFrame, max_gap_days: int = 6, seed_date: date = SEED_DATE, block: int = ORD_BLOCK
) -> DataFrame:
    """Add ``seq`` and ``split`` to points with ``component``, walking each component by ``ord``, not by date.

    Each point is compared with the one before it in source order, so a step back in time never splits.
    A component is walked in blocks of consecutive order numbers; only one row per block is carried over to
    the next one.
    """
    p = points.withColumn("_block", F.floor(F.col("ord") / F.lit(block)).cast("long"))
    within = Window.partitionBy("component", "_block").orderBy("ord")
    across = Window.partitionBy("component").orderBy("_block")
    upto = Window.unboundedPreceding
    last = p.groupBy("component", "_block").agg(F.max_by("date", "ord").alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(across)).drop("_last")
    previous = F.coalesce(F.lag("date").over(within), F.col("_carried"), F.lit(seed_date))
    flagged = settle(
        p.join(shuffled(carried), ["component", "_block"]).withColumn("split", F.datediff("date", previous) > max_gap_days), "walk"
    ).drop("_carried")
    opened = F.sum(F.col("split").cast("int"))
    before = flagged.groupBy("component", "_block").agg(opened.alias("_opened"))
    before = before.withColumn("_before", F.sum("_opened").over(across.rowsBetween(upto, -1))).drop("_opened")
    return (
        flagged.join(shuffled(before), ["component", "_block"])
        .withColumn("seq", opened.over(within.rowsBetween(upto, 0)) + F.coalesce("_before", F.lit(0)))
        .drop("_block", "_before")
    )


def fire_points_in_input_order(
    clean: DataFrame, dist_km: float = 2.0, max_gap_days: int = 6, seed_date: date = SEED_DATE
) -> DataFrame:
    """Cleaned detections with ``fire_id``, clusters split along the source order.

    Same as ``separate_fire_events(...).labelled_points()`` if the source is sorted by date.
    """
    points = settle(cluster.with_cell(clean, dist_km), "points")
    per_cell = points.groupBy("cell").agg(F.count(F.lit(1)).alias("_rows"), F.min("ord").alias("first_ord"))
    cells = settle(shuffled(per_cell).join(cluster.components(points, dist_km), "cell"), "cells")
    first = settle(cells.groupBy("component").agg(F.min("first_ord").alias("first_ord")), "first")
    cells = settle(shuffled(cells.drop("first_ord")).join(cluster.label(first).drop("first_ord"), "component"), "numbered")
    n_cells, n_rows = cells.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    named = lookup(
        points, cells.drop("_rows"), ["cell"], "inner", right_rows=n_cells, counts=(cells.select("cell", "_rows"), n_cells, n_rows)
    )
    walked = settle(split_in_input_order(named, max_gap_days, seed_date), "walked")

    w = Window.partitionBy("component").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    starts = walked.groupBy("component", "label", "seq").agg(
        F.min(F.when(F.col("split"), F.col("ord"))).alias("start"), F.count(F.lit(1)).alias("_rows")
    )
    chain = F.concat_ws("_", F.col("label").cast("string"), F.collect_list(F.col("start").cast("string")).over(w))
    ids = settle(starts.withColumn("fire_id", chain).select("component", "seq", "fire_id", "_rows"), "fire-ids")
    n_ids, weight = _sized(ids)
    return lookup(
        walked, ids.drop("_rows"), ["component", "seq"], "inner", n_ids, (ids.drop("fire_id"), n_ids, n_rows), weight
    ).select(
        "ord",
        np_round(F.col("lat"), ROUND_DECIMALS).alias("lat"),
        np_round(F.col("lon"), ROUND_DECIMALS).alias("lon"),
        "frp",
        "date",
        "fire_id",
    )


def fires_in_input_order(points: DataFrame, res_m: float = 375.0) -> DataFrame:
    """One row per ``fire_id``; first and last date are those of the first and last row, not the extremes."""
    ends = (
        points.groupBy("fire_id")
        .agg(F.min_by("date", "ord").alias("date_first"), F.max_by("date", "ord").alias("date_last"))
        .withColumn("duration_days", F.datediff("date_last", "date_first") + 1)
    )
    summary = fire_summary(points).drop("date_first", "date_last", "duration_days")
    return shuffled(summary).join(ends, "fire_id").join(shuffled(fire_area(points, res_m)), "fire_id", "left")


def largest_first(fires: DataFrame) -> DataFrame:
    return fires.orderBy(F.desc("count"), "fire_id")
