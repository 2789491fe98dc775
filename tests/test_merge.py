"""Merging many tables against pandas, and what the plan does for it."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.operators import merge
from emberline.plans import jobs


def tables(spark, hot=0):
    base = [(40.0, 1.0, "2024-01-05"), (None, 1.0, "2024-01-05"), (-0.0, 2.0, "2024-01-06"), (41.0, 3.0, None), (42.0, float("nan"), "2024-02-01")]
    rows = base + [(40.0, 1.0, "2024-01-05 00:00:00")] + [(50.0, 5.0, "2024-03-01")] * hot
    first = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, lat double, lon double, date string")
    second = spark.createDataFrame(
        [(40.0, 1.0, "2024-01-05", 1.0), (None, 1.0, "2024-01-05", 2.0), (0.0, 2.0, "2024-01-06", 3.0), (40.0, 1.0, "2024-01-05", 4.0), (50.0, 5.0, "2024-03-01", 9.0)],
        "lat double, lon double, date string, a double",
    )
    third = spark.createDataFrame(
        [(41.0, 3.0, None, "x"), (42.0, float("nan"), "2024-02-01", "y"), (40.0, 1.0, "2024-01-05", "z")]
        + [(50.0, 5.0, "2024-03-01", f"h{i % 3}") for i in range(hot // 4)],
        "lat double, lon double, date string, b string",
    )
    return [first, second, third]


def by_hand(parts):
    frames = []
    for df in parts:
        f = df.toPandas()
        place = lambda v: "null" if v is None else "nan" if v != v else repr(v + 0.0)
        rows = [r.asDict() for r in df.collect()]
        f["k"] = [(place(r["lat"]), place(r["lon"]), (r["date"] or "none")[:10]) for r in rows]
        frames.append(f)
    out = frames[0][["id", "k"]]
    for f in frames[1:]:
        out = out.merge(f.drop(columns=["lat", "lon", "date"]), on="k", how="left")
    return sorted((r.id, -1 if pd.isna(r.a) else r.a, "" if pd.isna(r.b) else r.b) for r in out.itertuples())


def shown(df):
    return sorted((r.id, -1 if r.a is None else r.a, r.b or "") for r in df.collect())


def test_nulls_nan_and_repeats_meet(spark):
    parts = tables(spark)
    assert shown(jobs.merge_features(parts)) == by_hand(parts)


@pytest.mark.parametrize("values", [10**9, 0])
def test_hot_keys(spark, monkeypatch, forced_big, values):
    monkeypatch.setattr(merge, "BROADCAST_VALUES", values)
    parts = tables(spark, hot=200)
    merged = jobs.merge_features(parts)
    assert merge._hot(*(lambda t: (t, merge._weights(t)))([merge.keyed(d, jobs.KEY) for d in jobs._dated(parts)])) is not None
    assert shown(merged) == by_hand(parts)


def many(spark, n):
    of = lambda c: spark.range(n).select((F.col("id") % 97).cast("double").alias("lat"), F.col("id").cast("double").alias("lon"), F.lit("2024-01-05").alias("date"), F.col("id").alias(c))
    return [of(c) for c in ("id", "a", "b", "c", "d")]


def test_one_exchange_a_table(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jobs.merge_features(many(spark, 5000))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 5 and plan.count("FileScan") == 5


def test_stored_tables_stay_in_place(spark, tmp_path):
    parts = tables(spark)
    jobs.store_features(spark, {f"stored_{i}": t for i, t in enumerate(parts)}, str(tmp_path), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = jobs.merge_stored(spark, [f"stored_{i}" for i in range(3)])
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 3
        assert shown(merged) == by_hand(parts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for i in range(3):
            spark.sql(f"DROP TABLE stored_{i}")


def test_each_input_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    parts = many(spark, 300)
    parts = [parts[0].mapInArrow(count, parts[0].schema), *parts[1:]]
    assert jobs.merge_features(parts).count() == 300 and seen.value == 300


def test_shared_columns_and_bad_dates(spark):
    a, b, _ = tables(spark)
    merged = jobs.merge_features([a.withColumn("a", F.lit("l")), b])
    assert merged.columns == ["id", "lat", "lon", "date", "a_x", "a_y"]
    with pytest.raises(Exception, match="no date"):
        jobs.merge_features([a, b.withColumn("date", F.lit("soon"))]).collect()
    with pytest.raises(ValueError):
        jobs.merge_features([a])
