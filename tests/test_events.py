import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.operators import clean, events
from emberline.plans import jobs

START = dt.date(2024, 3, 1)
CLEAN = "ord long, lat double, lon double, frp double, date date"


def points(spark, *rows):
    """(lat, lon, day) rows as cleaned detections."""
    return spark.createDataFrame([(i, float(a), float(o), 60.0, START + dt.timedelta(d)) for i, (a, o, d) in enumerate(rows)], CLEAN)


def ids(df):
    return [r["fire_id"] for r in df.orderBy("ord").collect()]


@pytest.mark.parametrize("gap, want", [(6, ["0_0", "0_0"]), (7, ["0_0", "0_0_1"])])
def test_gap_of_six_days_holds_and_seven_splits(spark, gap, want):
    split = events.separate_fire_events(points(spark, (40, 1, 0), (40, 1, gap)), 5.0)
    assert ids(split.labelled_points()) == want


def test_chain_of_splits_over_new_year(spark):
    df = points(spark, (40, 1, 300), (40, 1, 307), (40, 1, 308), (40, 1, 330), (50, 1, 0))
    assert ids(events.separate_fire_events(df, 5.0).labelled_points()) == ["0_0", "0_0_1", "0_0_1", "0_0_1_3", "1_4"]


def test_first_row_before_the_seed_date_has_no_suffix(spark):
    df = points(spark, (40, 1, -2000), (40, 1, -1998), (40, 1, -1000))
    assert ids(events.separate_fire_events(df, 5.0).labelled_points()) == ["0", "0", "0_2"]


def area(spark, *places, res=375.0):
    df = points(spark, *[(a, o, 0) for a, o in places]).withColumn("fire_id", F.lit("f"))
    return events.fire_area(df, res).first()["area_ha"]


def test_area_of_small_fires_and_the_rounding_tie(spark):
    assert area(spark, (40, 1)) == 14.06
    assert area(spark, (40, 1), (41, 2)) == 28.12
    assert area(spark, (40, 1), res=1000.0) == 100.0


def test_area_of_coincident_and_collinear_points(spark):
    disc = math.pi * 187.5**2 / 1e4
    assert area(spark, (40, 1), (40, 1), (40.001, 1.001)) == round(disc, 2)
    metres = 0.02 * math.pi / 180 * 6378137 * math.cos(math.pi / 6) / math.sqrt(1 - 0.00669437999014 * 0.25)
    assert area(spark, (40, 1), (40, 1.01), (40, 1.02)) == pytest.approx(disc + metres * 375 / 1e4, abs=0.02)


def test_hull_measure():
    assert events.hull_measure({(0.0, 0.0)}) == (0.0, 0.0)
    assert events.hull_measure({(0.0, 0.0), (3.0, 4.0)}) == (0.0, 10.0)
    square = {(x / 4, y / 4) for x in range(5) for y in range(5)}
    assert events.hull_measure(square) == pytest.approx((1.0, 4.0))
    t = np.linspace(0, 2 * np.pi, 2000, endpoint=False)
    got = events.hull_measure(set(zip(np.cos(t) + 1e6, np.sin(t) + 4e6)))
    assert got == pytest.approx((math.pi, 2 * math.pi), rel=1e-5)


def literal_walk(df, gap=6):
    """The row-by-row rule on one cluster."""
    last_id, last, out = "0", dt.date(2020, 1, 1), []
    for r in df.itertuples():
        if (r.date - last).days > gap:
            last_id = f"{last_id}_{r.ord}"
        out.append(last_id)
        last = r.date
    return out


@pytest.mark.parametrize("block", [4, 10**6])
def test_input_order_walk_goes_back_in_time(spark, monkeypatch, block):
    days = np.random.default_rng(5).integers(0, 60, 80)
    df = points(spark, *[(40, 1, int(d)) for d in days])
    monkeypatch.setattr(events.split_in_input_order, "__defaults__", (6, events.SEED_DATE, block))
    got = events.fire_points_in_input_order(df, 5.0)
    frame = df.toPandas()
    assert ids(got) == literal_walk(frame)
    frame["fire_id"] = literal_walk(frame)
    want = frame.groupby("fire_id")["date"].agg(["first", "last"])
    fires = {r["fire_id"]: (r["date_first"], r["date_last"]) for r in events.fires_in_input_order(got).collect()}
    assert fires == {k: tuple(v) for k, v in want.iterrows()}


def test_both_orders_agree_on_sorted_input(spark, views):
    cleaned = clean.clean_hotspots(views("hotspot").where("ord < 1000000000"))
    a = events.separate_fire_events(cleaned, 5.0).labelled_points()
    b = events.fire_points_in_input_order(cleaned, 5.0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_expected_figures_and_invariance(spark, views):
    fires = jobs.fetch_fires(views("hotspot"))
    assert fires.columns == ["fire_id", "lat_mean", "lon_mean", "frp_sum", "frp_mean", "count", "date_first", "date_last", "duration_days", "area_ha"]
    rows = fires.collect()
    assert len(rows) == 150 and sum(r["count"] for r in rows) == 310
    assert sum(r["count"] >= 3 for r in rows) == 43 and sum(r["count"] == 2 for r in rows) == 29
    assert [r["count"] for r in rows] == sorted((r["count"] for r in rows), reverse=True)
    again = jobs.fetch_fires(views("hotspot").repartition(7, F.rand(9)))
    assert [tuple(r) for r in again.collect()] == [tuple(r) for r in rows]


def test_gaps_inside_a_fire_never_exceed_the_limit(spark, views):
    named = events.separate_fire_events(clean.clean_hotspots(views("hotspot")), 5.0).labelled_points().toPandas()
    named["date"] = pd.to_datetime(named["date"])
    gaps = named.sort_values(["fire_id", "date"]).groupby("fire_id")["date"].diff().dt.days
    assert gaps.max() <= 6


def test_nothing_left_gives_an_empty_table(spark, views):
    assert jobs.fetch_fires(views("hotspot"), start="2031-01-01").count() == 0


def test_one_place_with_a_third_of_all_rows(spark):
    """A hot spot of copies, many days and many close places gives the same fires as its distinct rows."""
    hot = [(40.1 + (i % 40) * 1e-4, 1.15 + (i % 30) * 1e-4, i % 25) for i in range(1500)]
    rest = [(36 + (i % 50) * 0.2, -8 + (i // 50) * 0.3, i % 30) for i in range(3000)]
    split = events.separate_fire_events(points(spark, *hot, *rest), 5.0)
    fires = split.fires().collect()
    assert sum(r["count"] for r in fires) == 4500
    assert max(r["count"] for r in fires) == 1500
    assert split.tiles.groupBy("fire_id").count().agg(F.max("count")).first()[0] <= 25 * 3
