"""Null audits, profiles and the last cleaning."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.dates import DATE_FORMATS, parse_date
from emberline.operators.lineage import settle
from emberline.operators.raster import WATER_URBAN_COVER
from emberline.operators.summary import col, numeric_columns, summarise, text_columns

FLOATS = ("double", "float")


def missing(df: DataFrame, column: str) -> Column:
    c = col(column)
    return c.isNull() | F.isnan(c) if dict(df.dtypes)[column] in FLOATS else c.isNull()


def any_missing(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return reduce(lambda a, b: a | b, [missing(df, c) for c in columns or df.columns])


def normalise_date(
    df: DataFrame, column: str = "date", formats: Sequence[str] = DATE_FORMATS, strict: bool = False
) -> DataFrame:
    """Turn a date, timestamp or text column of mixed formats into a date.

    A text that is no date becomes NULL, or with ``strict`` an error.
    """
    if dict(df.dtypes)[column] != "string":
        return df.withColumn(column, F.to_date(column))
    value = parse_date(F.col(column), formats)
    if strict:  # reached only where nothing fits, so that no text is parsed twice
        problem = F.raise_error(F.concat(F.lit(f"no date in column {column}: "), F.col(column))).cast("date")
        value = F.coalesce(value, F.when(F.col(column).isNotNull(), problem))
    return df.withColumn(column, value)


def rows_with_null(df: DataFrame, columns: Sequence[str] | None = None, final: int | None = None) -> DataFrame:
    kept = df if final is None else df.where(F.col("final") == final)
    return kept.where(any_missing(df, columns))


def null_audit(df: DataFrame, by: str = "final", columns: Sequence[str] | None = None) -> DataFrame:
    """``by, column, nulls, rows, rows_with_null, pct_rows_with_null``: one pass, a few numbers per class."""
    columns = [c for c in columns or df.columns if c != by]
    count = lambda cond: F.sum(cond.cast("long"))
    wide = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        count(any_missing(df, columns)).alias("rows_with_null"),
        *[count(missing(df, c)).alias(f"_n{i}") for i, c in enumerate(columns)],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("nulls")) for i, c in enumerate(columns)])
    return wide.withColumn("p", F.explode(pairs)).select(
        by,
        "p.column",
        "p.nulls",
        "rows",
        "rows_with_null",
        (F.col("rows_with_null") / F.col("rows") * 100).alias("pct_rows_with_null"),
    )


def completeness(df: DataFrame) -> DataFrame:
    """``column, non_null, rows, cells, non_null_total, pct_total``."""
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum((~missing(df, c)).cast("long")), F.lit(0)).alias(f"_n{i}") for i, c in enumerate(df.columns)],
    )
    total = reduce(lambda a, b: a + b, [F.col(f"_n{i}") for i in range(len(df.columns))])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("non_null")) for i, c in enumerate(df.columns)]
    )
    cells = F.col("rows") * len(df.columns)
    return (
        wide.withColumn("non_null_total", total)
        .withColumn("p", F.explode(pairs))
        .select(
            "p.column",
            "p.non_null",
            "rows",
            cells.alias("cells"),
            "non_null_total",
            (F.col("non_null_total") / cells * 100).alias("pct_total"),
        )
    )


def _long(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    if not columns:
        return df.sparkSession.createDataFrame([], f"column string, value {kind}")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, count, mean, std, min, p25, p50, p75, max``; the quantiles are exact. A column without values has count 0."""
    columns = list(columns or numeric_columns(df))
    return summarise(df.select(*[col(c) for c in columns]), columns, []).stats


def value_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, value, n, share`` of every value of the text columns, NULL included."""
    rows = df.count()
    counted = _long(df, columns or text_columns(df), "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.lit(float(rows or 1)))


def n_unique(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, n_unique`` without NULL: values are made unique first, then counted."""
    values = _long(df, columns or text_columns(df), "string").distinct()
    return values.groupBy("column").agg(F.count("value").alias("n_unique"))


def monthly_nulls(points: DataFrame, null_rows: DataFrame, date: str = "date") -> DataFrame:
    """``month, rows, rows_with_null, pct``: months of ``points``, nulls from ``null_rows``."""
    count = lambda df, name: df.groupBy(F.month(date).alias("month")).agg(F.count(F.lit(1)).alias(name))
    met = count(points, "rows").join(count(null_rows, "rows_with_null"), "month", "left")
    return met.withColumn("rows_with_null", F.coalesce("rows_with_null", F.lit(0))).withColumn(
        "pct", F.col("rows_with_null") / F.col("rows") * 100
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin, low, high, n`` of equal bins from minimum to maximum; the last bin is closed."""
    value = F.col(column).cast("double")
    values = df.select(value.alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    number = F.least(F.floor((F.col("v") - low) / (high - low) * bins) + 1, F.lit(bins)).cast("int")
    width = (high - low) / bins
    counted = values.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(counted, "bin", "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        .select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("low"), (F.lit(low) + F.col("bin") * width).alias("high"), "n")
    )


def histograms(df: DataFrame, by: str, column: str, bins: int) -> DataFrame:
    """``by, bin, low, high, n``: a ``histogram`` for each of a few groups, all in two scans. A group without values has none."""
    values = df.select(by, F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    narrow = F.when(F.col("_low") == F.col("_high"), 0.5).otherwise(0.0)
    span = values.groupBy(by).agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    span = settle(span.select(by, (F.col("_low") - narrow).alias("_low"), (F.col("_high") + narrow).alias("_high")), "histogram-spans")
    number = F.floor((F.col("v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins) + 1
    met = values.join(F.broadcast(span), by).select(by, F.least(number, F.lit(bins)).cast("int").alias("bin"))
    every = span.select(by, "_low", "_high", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("_high") - F.col("_low")) / bins
    counted = every.join(met.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n")), [by, "bin"], "left")
    return counted.select(
        by,
        "bin",
        (F.col("_low") + (F.col("bin") - 1) * width).alias("low"),
        (F.col("_low") + F.col("bin") * width).alias("high"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def null_keys_union(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of the rows with a NULL in either of two tables, each once."""
    return rows_with_null(left).select(*key).union(rows_with_null(right).select(*key)).distinct()


def drop_unusable_cover(df: DataFrame, column: str = "vegetacion2") -> DataFrame:
    """Without rows whose cover is "otro" or "sin datos", in any case and with any space around."""
    word = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?U)^\s+", ""), r"(?U)\s+$", ""))
    return df.where(~word.isin("otro", "sin datos"))


def drop_water_urban(df: DataFrame, legend: DataFrame, column: str = "vegetacion2") -> DataFrame:
    """Without rows whose cover is a label of a water or urban code, whatever number of labels a code has."""
    labels = legend.where(F.col("code").isin(*WATER_URBAN_COVER)).select(F.col("label").alias(column)).distinct()
    return df.join(labels, column, "left_anti")
