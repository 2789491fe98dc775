import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.operators import summary

SHAPES = {
    "one": lambda r: r.normal(size=1),
    "two": lambda r: r.normal(size=2),
    "few": lambda r: r.normal(size=37),
    "many": lambda r: r.normal(size=40_000),
    "ties": lambda r: r.integers(0, 3, 30_000) * 1.0,
    "one value": lambda r: np.full(5_000, 2.5),
    "skewed": lambda r: np.exp(r.normal(size=30_000) * 4),
    "two heaps": lambda r: np.where(r.random(30_000) < 0.5, -1e9, 1e-9) + r.normal(size=30_000) * 1e-12,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_statistics_are_exact(spark, shape):
    values = SHAPES[shape](np.random.default_rng(5))
    frame = pd.DataFrame({"a.b": values, "_": np.arange(len(values))})
    got = summary.summarise(spark.createDataFrame(frame)).stats.toPandas().set_index("column")
    want = frame.describe().T
    for c in frame:
        parts = ["count", "mean", "min", "25%", "50%", "75%", "max"]
        assert list(got.loc[c].drop("std")) == pytest.approx(list(want.loc[c][parts]), rel=1e-12, abs=1e-15), c


def test_two_scans_whatever_the_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    wide = spark.range(2000).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(12)], F.col("id").cast("string").alias("t"))
    wide.write.parquet(path)
    passes = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        passes.add(1)
        return v

    df = spark.read.parquet(path).withColumn("c1", seen(F.col("c1")).alias("c1"))
    found = summary.summarise(df)
    assert found.stats.count() == 12 and summary.n_unique(found).first()["n_unique"] == 2000
    assert summary.value_shares(found).count() == 2000
    scanned = passes.value
    summary.summarise(spark.read.parquet(path).select(seen(F.col("c1")).alias("c1")))
    assert scanned == passes.value - scanned  # as often as a table of one column


def test_empty_null_nan_and_texts(spark):
    schema = "x double, y int, t string, d date"
    nothing = summary.summarise(spark.createDataFrame([], schema))
    assert nothing.rows == 0 and {(r["column"], r["count"], r["p50"]) for r in nothing.stats.collect()} == {("x", 0, None), ("y", 0, None)}
    assert summary.value_shares(nothing).count() == 0
    assert summary.completeness(nothing, nothing.stats).first()["pct_total"] is None
    df = spark.createDataFrame([(float("nan"), None, None, None), (1.0, 3, "", None), (float("inf"), None, "", None)], schema)
    found = summary.summarise(df)
    got = {r["column"]: (r["count"], r["min"], r["max"]) for r in found.stats.collect()}
    assert got == {"x": (2, 1.0, float("inf")), "y": (1, 3.0, 3.0)}
    assert found.non_null == {"x": 2, "y": 1, "t": 2, "d": 0}
    assert {(r["value"], r["n"]) for r in summary.value_shares(found).collect()} == {(None, 1), ("", 2)}
    assert {r["column"]: r["n_unique"] for r in summary.n_unique(found).collect()} == {"t": 1}
