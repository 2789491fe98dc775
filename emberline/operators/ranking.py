"""Rank over a whole table without putting it into one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_points(df: DataFrame, column: str, parts: int) -> list[float]:
    """Values that cut ``column`` into about equal parts."""
    probs = [i / parts for i in range(1, parts)]
    return sorted(set(df.approxQuantile(column, probs, 1 / (4 * parts)))) if probs else []


def bucket_of(column, bounds: list[float]):
    """Number of bounds at or below the value: equal values share a bucket."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= column))


def global_rank(df: DataFrame, order: str, name: str) -> DataFrame:
    """0-based rank of each row by ``order`` (unique values). ``df`` should be settled.

    Rows are cut into value ranges, ranked inside each, and shifted by the number of rows in the ranges
    before. Only the ranges' counts, at most one per shuffle partition, meet in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = df.withColumn("_bucket", bucket_of(F.col(order), split_points(df, order, min(parts, 512))))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn(
        "_before", F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ).select("_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(order))
    return (
        bucketed.withColumn("_place", place)
        .join(F.broadcast(before), "_bucket")
        .withColumn(name, F.col("_before") + F.col("_place") - 1)
        .drop("_bucket", "_place", "_before")
    )
