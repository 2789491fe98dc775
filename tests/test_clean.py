import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberline.operators import clean
from emberline.schema import HOTSPOT

DAY = dt.date(2024, 3, 1)


def hotspots(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], HOTSPOT)


def test_missing_confidence_stays_and_low_goes(spark):
    df = hotspots(spark, (1.0, 1.0, DAY, "l", 90.0), (2.0, 1.0, DAY, None, 90.0), (3.0, 1.0, DAY, "h", 90.0))
    assert [r["lat"] for r in clean.clean_hotspots(df).orderBy("lat").collect()] == [2.0, 3.0]


def test_power_threshold_is_strict(spark):
    df = hotspots(spark, (1.0, 1.0, DAY, "n", 50.0), (2.0, 1.0, DAY, "n", 50.01), (3.0, 1.0, DAY, "n", None), (4.0, 1.0, DAY, "n", float("nan")))
    assert [r["lat"] for r in clean.clean_hotspots(df).collect()] == [2.0]


def test_weak_first_row_hides_a_strong_copy_but_a_low_one_does_not(spark):
    df = hotspots(
        spark,
        (1.0, 1.0, DAY, "n", 20.0),
        (1.0, 1.0, DAY, "n", 99.0),
        (2.0, 1.0, DAY, "l", 20.0),
        (2.0, 1.0, DAY, "n", 99.0),
        (2.0, 1.0, DAY, "n", 70.0),
    )
    got = clean.clean_hotspots(df.orderBy(F.rand(1))).collect()
    assert [(r["lat"], r["frp"], r["ord"]) for r in got] == [(2.0, 99.0, 3)]


def test_text_dates_and_rows_without_a_place(spark):
    df = hotspots(spark, (1.0, 1.0, DAY, "n", 60.0), (None, 1.0, DAY, "n", 60.0), (float("nan"), 1.0, DAY, "n", 60.0))
    text = df.withColumn("acq_date", F.lit("2024-03-01")).unionByName(
        df.limit(1).withColumn("acq_date", F.lit("yesterday")).withColumn("latitude", F.lit(5.0))
    )
    assert [(r["lat"], r["date"]) for r in clean.clean_hotspots(text).collect()] == [(1.0, DAY)]


@pytest.mark.parametrize(
    "start, end, n", [(None, None, 5), ("2024-03-02", None, 4), (None, dt.date(2024, 3, 2), 2), ("2024-03-02", "2024-03-04", 3)]
)
def test_date_range_includes_both_ends(spark, start, end, n):
    df = spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(5)], "date date")
    assert clean.date_range(df, start, end).count() == n


@pytest.mark.parametrize("n, rows", [(None, 5), (-1, 5), (2, 2), (0, 0)])
def test_head(spark, n, rows):
    assert [r["id"] for r in clean.head(spark.range(5), n, F.desc("id")).collect()][:2] == [4, 3][: min(rows, 2)] or n in (None, -1)
    assert clean.head(spark.range(5), n, F.desc("id")).count() == rows


def test_date_filter_reaches_the_scan_and_power_stays_above(spark, tmp_path):
    path = str(tmp_path / "h")
    hotspots(spark, (1.0, 1.0, DAY, "n", 60.0)).write.parquet(path)
    df = clean.date_range(clean.clean_hotspots(spark.read.parquet(path)), "2024-01-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "acq_date" in pushed and "frp" not in pushed.split("ReadSchema")[0]
    assert "Window" not in plan
