"""Exact interpolated quantiles that no task has to hold a whole group for."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.lineage import settle
from emberline.operators.ranking import bucket_of, split_points
from emberline.operators.skew import shuffled


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``keys`` (not NULL) and one column per entry of ``probs``; NULL values are ignored.

    Equal values are combined first. The distinct values are cut into ranges of about equal size; counts per
    range tell which range holds the wanted rank, and only that range is ordered.
    """
    keys = list(keys)
    values = settle(
        df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")),
        "values",
    )
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 512)
    values = values.withColumn("_bucket", bucket_of(F.col("_v"), split_points(values, "_v", parts)))
    group = Window.partitionBy(*keys)
    sizes = (
        values.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_upto", F.sum("_size").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_size").over(group))
    )
    wanted = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        for rank, weight in ((F.floor(at), 1 - (at - F.floor(at))), (F.floor(at) + 1, at - F.floor(at))):
            wanted.append(
                F.struct(
                    F.lit(name).alias("name"),
                    (rank - (F.col("_upto") - F.col("_size"))).alias("rank"),
                    weight.alias("weight"),
                )
            )
    targets = sizes.withColumn(
        "_wanted",
        F.filter(F.array(*wanted), lambda t: (t["weight"] > 0) & (t["rank"] >= 0) & (t["rank"] < F.col("_size"))),
    ).where(F.size("_wanted") > 0)
    here = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        shuffled(values).join(targets.select(*keys, "_bucket", "_wanted"), [*keys, "_bucket"])
        .withColumn("_last", F.sum("_n").over(here))
        .withColumn(
            "_hit",
            F.explode(
                F.filter(
                    "_wanted", lambda t: (t["rank"] < F.col("_last")) & (t["rank"] >= F.col("_last") - F.col("_n"))
                )
            ),
        )
    )
    return hits.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_hit.name") == n, F.col("_v") * F.col("_hit.weight"))).alias(n) for n in probs]
    )
