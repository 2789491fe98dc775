from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.operators import cluster, events, quantiles, ranking, raster
from emberline.operators.lineage import checkpoint_root, settle
from emberline.operators.skew import bucket_sizes, few, hot_keys, lookup, repeat_rows, shuffled, skew_join


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, v) for v in r])


@pytest.fixture
def skewed(spark):
    """A third of the rows on one key, some without a key, some unknown to the other side."""
    left = spark.range(6000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 50 == 1, None)
        .otherwise(F.col("id") % 997)
        .cast("long")
        .alias("k"),
    )
    right = spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    return left, right


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("big", [False, True])
def test_lookup_equals_plain_join(skewed, how, big, request):
    if big:
        request.getfixturevalue("forced_big")
    left, right = skewed
    want = left.join(right, "k", how).select("id", "k", "v")
    got = lookup(left, right, ["k"], how).select("id", "k", "v")
    assert rows(got) == rows(want)


def test_lookup_keeps_hot_and_null_keys_out_of_the_shuffle(skewed, forced_big, monkeypatch):
    left, right = skewed
    seen = []
    monkeypatch.setattr(forced_big, "settle", lambda df, name: seen.append((name, df)) or settle(df, name))
    lookup(left, right, ["k"])
    (union,) = [df for name, df in seen if name == "looked-up"]
    plan = union._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("how", ["left", "inner"])
def test_skew_join_many_to_many_with_copies_and_nulls(spark, forced_big, how):
    left = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).cast("long").alias("k"),
        F.when(F.col("id") % 6 < 4, 0).otherwise(F.col("id") % 5).alias("a"),
    )
    right = spark.range(120).select(
        F.when(F.col("id") < 40, 1).when(F.col("id") < 44, None).otherwise(F.col("id")).cast("long").alias("k"),
        (F.col("id") % 4).alias("b"),
    )
    assert hot_keys(left, ["k"]) is not None
    got = skew_join(left, right, ["k"], how).select("k", "a", "b").toPandas()
    want = left.toPandas().merge(right.toPandas(), on="k", how=how)[["k", "a", "b"]]
    tidy = lambda d: d.astype("float64").sort_values(["k", "a", "b"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want))


def test_no_hot_key_means_a_plain_join(spark):
    left = spark.range(1000).withColumnRenamed("id", "k")
    assert sum(bucket_sizes(left, ["k"]).values()) == 1000
    assert hot_keys(left, ["k"]) is None
    plan = skew_join(left, left.withColumn("v", F.lit(1)), ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_repeat_rows_cuts_large_counts(spark, forced_big):
    df = spark.createDataFrame([("a", 100), ("b", 1), ("c", 0), ("d", -3), ("e", 16)], "k string, n long")
    got = repeat_rows(df, "n", "i")
    assert rows(got.groupBy("k").agg(F.count("*"), F.min("i"), F.max("i"), F.count_distinct("i"))) == [
        ("a", 100, 0, 99, 100),
        ("b", 1, 0, 0, 1),
        ("e", 16, 0, 15, 16),
    ]


def test_global_rank(spark):
    values = np.random.default_rng(1).choice(10**9, 5000, replace=False)
    df = settle(spark.createDataFrame([(int(v),) for v in values], "v long"), "ranks")
    got = {r["v"]: r["rank"] for r in ranking.global_rank(df, "v", "rank").collect()}
    assert got == {int(v): i for i, v in enumerate(sorted(values))}


def test_quantiles_with_a_hot_group_and_many_equal_values(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"k": rng.choice(["hot", "a", "b"], 3000, p=[0.8, 0.15, 0.05]), "v": rng.normal(size=3000).round(2)})
    frame.loc[frame.index % 4 == 0, "v"] = 0.5
    frame = pd.concat([frame, pd.DataFrame({"k": ["one"], "v": [3.0]})])
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    got = {r["k"]: [r[p] for p in probs] for r in quantiles.quantiles(spark.createDataFrame(frame), ["k"], "v", probs).collect()}
    for k, group in frame.groupby("k"):
        assert got[k] == pytest.approx(np.quantile(group["v"], list(probs.values())))
    whole = quantiles.quantiles(spark.createDataFrame(frame), [], "v", {"median": 0.5}).first()["median"]
    assert whole == pytest.approx(frame["v"].median())


def session(setting=None, current=None, master="local[2]"):
    """Just enough of a session to ask for its checkpoint folder."""
    state = {"dir": current}
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda d: state.update(dir=d)
    )
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=context)


def test_checkpoint_folder_comes_from_the_session():
    assert checkpoint_root(session("s3a://shared/ck")) == "s3a://shared/ck"
    assert checkpoint_root(session(None, "hdfs:///ck", "yarn")) == "hdfs:///ck"
    own = session()
    assert checkpoint_root(own) == checkpoint_root(own) and "emberline" in checkpoint_root(own)
    with pytest.raises(RuntimeError):
        checkpoint_root(session(master="spark://host:7077"))


def test_settled_tables_lie_in_the_folder_and_cut_lineage(spark):
    df = settle(spark.range(3).withColumn("x", F.col("id") * 2), "t")
    assert df.count() == 3
    (folder,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    assert checkpoint_root(spark).removeprefix("file:").rstrip("/") in folder
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def joins_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def test_sides_that_grow_with_the_data_are_not_broadcast(spark):
    """Small files may hold many rows, and ``explode`` makes more of them: none of this may pass through the driver."""
    from emberline.functions.geo import RasterMeta

    grid = spark.range(400).select((F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.lit(1.0).alias("value"))
    stored, meta = settle(grid, "grid"), RasterMeta(0.0, 10.0, 0.5, 0.5, 20, 20, -1.0)
    points = spark.range(50).select((F.col("id") / 100).alias("lat"), F.lit(3.0).alias("lon"))
    cells = settle(cluster._extent(cluster.with_cell(points, 5.0), ["cell"]), "cells")
    a, b = stored.select("row", "col"), stored.select("row", "col", F.lit(1).alias("n"))
    assert joins_of(a.join(b, ["row", "col"])) == (0, 1)
    assert joins_of(shuffled(a).join(b, ["row", "col"])) == (1, 0)
    assert joins_of(cluster._candidates(cells, 5.0)) == (2, 0)
    assert joins_of(raster.slope_from_dem(a, stored, meta)) == (1, 0)
    assert joins_of(raster.filled_pixels(a, stored, meta))[1] == 0
    spread = settle(grid.withColumn("g", F.col("row")), "spread")
    assert joins_of(quantiles.quantiles(spread, ["g"], "value", {"median": 0.5}))[1] == 0


def test_few_counts_bytes_not_only_rows(spark):
    narrow = spark.range(1).select(F.col("id").alias("k"), F.col("id").alias("v"))
    wide = narrow.select("k", *[F.col("v").alias(f"v{i}") for i in range(20)])
    chained = narrow.select("k", F.col("v").cast("string").alias("fire_id"))
    assert few(narrow, 50_000) and not few(narrow, 150_000)
    assert few(wide, 15_000) and not few(wide, 50_000)
    assert few(chained, 30_000) and not few(chained, 30_000, weight=10)


def test_wide_answers_to_many_keys_are_not_broadcast(spark):
    left = spark.range(60_000).select("id", F.col("id").alias("k"))
    right = left.select("k", *[F.col("id").alias(f"v{i}") for i in range(12)])
    got = lookup(left, right, ["k"])
    assert "looked-up" in "".join(got.inputFiles())  # took the way of many keys; a broadcast would not be written
    assert got.count() == 60_000 and got.where("v11 <> id OR v0 IS NULL").isEmpty()


def test_size_of_chained_ids_weighs(spark):
    ids = spark.range(4).select(F.lit("x" * 640).alias("fire_id"))
    assert events._sized(ids) == (4, 11)
    assert events._sized(ids.limit(0)) == (0, 1)
