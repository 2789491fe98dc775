"""From raw detections to usable ones."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_low_confidence(df: DataFrame) -> DataFrame:
    """Everything but confidence ``l``; detections without a confidence stay."""
    return df.where(~F.col("confidence").eqNullSafe(F.lit("l")))


def min_frp(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Strictly above the threshold. NaN, which Spark orders above all numbers, is not."""
    return df.where((F.col("frp") > threshold) & ~F.isnan("frp"))


def dedup_first(df: DataFrame) -> DataFrame:
    """One detection per place and day: the first in source order.

    An aggregation instead of a window, so copies of one detection are combined before the shuffle.
    """
    return df.groupBy("latitude", "longitude", "acq_date").agg(
        F.min_by("frp", "ord").alias("frp"), F.min("ord").alias("ord")
    )


def clean_hotspots(df: DataFrame, min_power: float = 50.0) -> DataFrame:
    """``ord, lat, lon, frp, date`` of the usable detections.

    The power threshold comes after the de-duplication: a weak first detection hides a strong copy.
    Detections without a place or a day cannot be clustered and are left out.
    """
    day = F.to_date(F.col("acq_date")) if dict(df.dtypes)["acq_date"] != "string" else F.try_to_date("acq_date")
    dated = drop_low_confidence(df).withColumn("acq_date", day)
    placed = dated.where(
        F.col("acq_date").isNotNull()
        & F.col("latitude").isNotNull()
        & F.col("longitude").isNotNull()
        & ~F.isnan("latitude")
        & ~F.isnan("longitude")
    )
    return min_frp(dedup_first(placed), min_power).select(
        "ord",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        "frp",
        F.col("acq_date").alias("date"),
    )


def date_range(df: DataFrame, start: date | str | None = None, end: date | str | None = None, column: str = "date"):
    """Rows within the bounds, both included; a missing bound does not restrict."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def head(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """First ``n`` rows in the given order; ``None`` or -1 means all."""
    if n is None or n == -1:
        return df
    return df.orderBy(*order).limit(n)
