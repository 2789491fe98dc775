import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.operators import quality
from emberline.plans import jobs


@pytest.fixture
def table(spark):
    rows = [
        (1, 1.0, "a", "2024-01-05"),
        (1, None, "b", "2024-01-06"),
        (0, float("nan"), None, "2024-02-01"),
        (0, 4.0, "a", "2024-02-02"),
        (0, 8.0, "a", None),
    ]
    return spark.createDataFrame(rows, "final int, x double, t string, date string")


def test_null_audit_counts_nan_and_null_per_class(table):
    got = {(r["final"], r["column"]): tuple(r)[2:] for r in quality.null_audit(table).collect()}
    assert got[(1, "x")] == (1, 2, 1, 50.0)
    assert got[(0, "x")][:3] == (1, 3, 2) and got[(0, "t")][0] == 1 and got[(0, "date")][0] == 1


def test_completeness(table):
    got = {r["column"]: (r["non_null"], r["rows"], r["cells"], r["pct_total"]) for r in quality.completeness(table).collect()}
    assert got["x"] == (3, 5, 20, 80.0) and got["final"][0] == 5


def test_describe_equals_pandas(spark):
    frame = pd.DataFrame({"a": np.random.default_rng(3).normal(size=500), "b": np.arange(500) % 7.0})
    frame.loc[::9, "a"] = np.nan
    got = quality.describe(spark.createDataFrame(frame)).toPandas().set_index("column")
    want = frame.describe().T
    for c in frame:
        assert list(got.loc[c]) == pytest.approx(list(want.loc[c]))


def test_value_shares_and_distinct_counts(table):
    shares = {(r["column"], r["value"]): r["share"] for r in quality.value_shares(table).collect()}
    assert shares[("t", "a")] == 0.6 and shares[("t", None)] == 0.2
    assert {r["column"]: r["n_unique"] for r in quality.n_unique(table).collect()} == {"t": 2, "date": 4}


def test_no_text_columns(table):
    assert quality.value_shares(table.select("x")).count() == 0


@pytest.mark.parametrize("bins", [1, 4, 15])
def test_histogram_equals_numpy(spark, bins):
    values = np.concatenate([np.random.default_rng(4).uniform(0, 10, 300), [0.0, 10.0]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = {r["bin"]: r["n"] for r in quality.histogram(df, "v", bins).collect()}
    counts, edges = np.histogram(values, bins)
    assert got == {i + 1: n for i, n in enumerate(counts) if n}
    assert quality.histogram(df, "v", bins).agg(F.max("high")).first()[0] == pytest.approx(edges[-1])


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [tuple(r) for r in quality.histogram(df, "v", 2).orderBy("bin").collect()] == [(1, 2.5, 3.0, 0), (2, 3.0, 3.5, 2)]


def test_unusable_words_in_any_dress(spark):
    words = ["Otro", " otro ", "\tSIN DATOS\n", " otro", "otros", None, ""]
    df = spark.createDataFrame([(w,) for w in words], "vegetacion2 string")
    assert [r[0] for r in quality.drop_unusable_cover(df).collect()] == ["otros", None, ""]


def test_water_and_urban_labels_go_and_null_stays(spark):
    legend = spark.createDataFrame([(3, "city"), (12, "pine")], "code int, label string")
    df = spark.createDataFrame([("city",), ("pine",), (None,)], "vegetacion2 string")
    assert {r[0] for r in quality.drop_water_urban(df, legend).collect()} == {"pine", None}


def test_mixed_dates_become_days(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-01-05 10:00:00",), ("2024-01-05T10:00:00",), ("?",)], "date string")
    assert [str(r[0]) for r in quality.normalise_date(df).collect()] == ["2024-01-05"] * 3 + ["None"]


def test_null_keys_of_two_tables_once(spark):
    a = spark.createDataFrame([(1, None), (2, 1.0), (3, None)], "k int, x double")
    b = spark.createDataFrame([(3, None), (4, None), (5, 1.0)], "k int, y double")
    assert sorted(r[0] for r in quality.null_keys_union(a, b, ["k"]).collect()) == [1, 3, 4]


def test_monthly_nulls(table):
    days = quality.normalise_date(table)
    got = {r["month"]: (r["rows"], r["rows_with_null"]) for r in quality.monthly_nulls(days, quality.rows_with_null(days)).collect()}
    assert got[1] == (2, 1) and got[2] == (2, 1)


def test_merge_needs_two_tables_matches_nulls_and_multiplies_copies(spark):
    a = spark.createDataFrame([(1.0, 2.0, "2024-01-05"), (None, 2.0, "2024-01-05 00:00:00"), (9.0, 9.0, None)], "lat double, lon double, date string")
    b = spark.createDataFrame([(1.0, 2.0, "2024-01-05 03:00:00", 1), (1.0, 2.0, "2024-01-05", 2), (None, 2.0, "2024-01-05", 3)], "lat double, lon double, date string, f int")
    got = sorted((r["lat"] or 0, r["f"] or 0) for r in jobs.merge_features([a, b]).collect())
    assert got == [(0, 3), (1.0, 1), (1.0, 2), (9.0, 0)]
    with pytest.raises(ValueError):
        jobs.merge_features([a])


def test_label_union_renames_and_fills(spark):
    fires = spark.createDataFrame([("f", 1.0, 2.0, "2024-01-01", 7)], "fire_id string, lat_mean double, lon_mean double, date_first string, count int")
    others = spark.createDataFrame([(3.0, 4.0, "2024-01-02")], "lat double, lon double, date string")
    got = {r["final"]: r for r in jobs.label_union(fires, others).collect()}
    assert got[0]["lat_mean"] == 3.0 and got[0]["count"] is None and got[0]["fire_id"] is None
    assert got[1]["count"] == 7
    assert jobs.feature_join(jobs.label_union(fires, others), others.withColumn("f", F.lit(1))).count() == 1


def test_profile_parts(views):
    parts = jobs.profile(views("feature_cover"))
    assert set(parts) == {"head", "completeness", "describe", "value_shares", "n_unique"}
    assert parts["head"].count() == 10
    assert all(df.count() for df in parts.values())


def test_date_spellings(spark):
    texts = ["03/04/2024", "25/12/2024", "2024-01-05 10:00", "2024-01-05T10:00:00.123456", "2024-01-05T10:00:00Z", "2024/01/05", "no date", None]
    df = spark.createDataFrame([(t,) for t in texts], "date string")
    got = [str(r[0]) for r in quality.normalise_date(df).collect()]
    assert got == ["2024-03-04", "2024-12-25", *["2024-01-05"] * 4, "None", "None"]
    with pytest.raises(Exception, match="no date"):
        quality.normalise_date(df, strict=True).collect()


def test_columns_without_values_and_all_labels(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert {r["column"]: r["count"] for r in quality.describe(df).collect()} == {"a": 2, "b": 0}
    bins = quality.histogram(spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "v double"), "v", 9)
    assert [r.n for r in bins.orderBy("bin").collect()] == [1, 1, 0, 0, 0, 0, 0, 0, 1]
    code = min(quality.WATER_URBAN_COVER)
    legend = spark.createDataFrame([(code, "lake"), (code, "river")], "code int, label string")
    kept = quality.drop_water_urban(spark.createDataFrame([("lake",), ("river",), ("pine",)], "vegetacion2 string"), legend)
    assert [r[0] for r in kept.collect()] == ["pine"]


def test_merge_suffixes_shared_columns(spark):
    from emberline.plans.jobs import merge_features

    make = lambda v: spark.createDataFrame([(1.0, 2.0, "2024-01-05", v)], "lat double, lon double, date string, final int")
    merged = merge_features([make(1), make(2), make(3)])
    assert sorted(merged.columns) == ["date", "final", "final_x", "final_y", "lat", "lon"]
    assert (merged.first().final_x, merged.first().final_y, merged.first().final) == (1, 2, 3)
