"""A whole table described in two scans, whatever the number of its columns; all figures are exact.

The first scan counts, adds up and sketches every numeric column at once. Sketches merge, and what they say of a rank is off
by a known share of the rows, so they give an interval that must hold each wanted quantile. The second scan takes from every row
the values in such an interval, how many lie below it, and the texts, all combined before the shuffle. Only few values per
quantile are left to be ordered, by ranges. The driver sees a few numbers for each column.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.lineage import settle
from emberline.operators.ranking import bucket_of, split_points

QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
#: A sketch is off by one in so many ranks at most; its grid gets finer towards the wanted quantiles, down to 2 ** -STEPS.
ACCURACY, STEPS = 20_000, 11
FLOATS = ("double", "float")
INTEGERS = ("tinyint", "smallint", "int", "bigint")
STATISTICS = "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"


@dataclass(frozen=True)
class Summary:
    """``rows``, non-NULL values by column, ``stats`` (one row a numeric column) and ``texts`` (``column, value, n``; settled)."""

    rows: int
    non_null: dict[str, int]
    stats: DataFrame
    texts: DataFrame


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in INTEGERS + FLOATS or t.startswith("decimal")]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def _number(c: str) -> Column:
    """NULL and NaN are no values."""
    v = col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _grid() -> list[float]:
    around = {p + sign * 2.0**-k for p in QUANTILES.values() for k in range(1, STEPS + 1) for sign in (-1, 1)}
    return sorted({0.0, 1.0} | {p for p in around if 0 < p < 1})


def _wanted(n: int) -> list[tuple[str, int, float]]:
    """Name, rank from 0 and weight of the values that make up each quantile of ``n`` values."""
    out = []
    for name, p in QUANTILES.items():
        at = p * (n - 1)
        out += [(name, r, w) for r, w in ((math.floor(at), 1 - at % 1), (math.floor(at) + 1, at % 1)) if w > 0]
    return out


def _interval(ranks: Sequence[int], n: int, grid: Sequence[float], values: Sequence[float]) -> tuple[float, float]:
    """Values between which all ``ranks`` lie for certain, a rank on either side to spare."""
    slack = 1 / ACCURACY
    low = max((i for i, g in enumerate(grid) if g <= (min(ranks) - 1) / n - slack), default=0)
    high = min((i for i, g in enumerate(grid) if g >= (max(ranks) + 2) / n + slack), default=len(grid) - 1)
    return values[low], values[high]


def _counted(df: DataFrame, intervals: Sequence[tuple[str, str, float, float]], texts: Sequence[str]) -> DataFrame:
    """``slot, v, t, n``: the second scan. Slots are the intervals, then the texts; a value below its interval has no ``v``."""
    parts = []
    for i, (c, _, low, high) in enumerate(intervals):
        v = _number(c)
        inside = F.when(v >= low, v)
        parts.append(F.when(v <= high, F.struct(F.lit(i).alias("slot"), inside.alias("v"), F.lit(None).cast("string").alias("t"))))
    for i, c in enumerate(texts, len(intervals)):
        parts.append(F.struct(F.lit(i).alias("slot"), F.lit(None).cast("double").alias("v"), col(c).alias("t")))
    if not parts:
        return df.sparkSession.createDataFrame([], "slot int, v double, t string, n long")
    each = df.select(F.explode(F.array(*parts)).alias("p")).where("p IS NOT NULL").select("p.*")
    return settle(each.groupBy("slot", "v", "t").agg(F.count(F.lit(1)).alias("n")), "summary-values")


def _at_ranks(values: DataFrame, ranks: Sequence[tuple[int, int, int]]) -> dict[tuple[int, int], float]:
    """The values at the ranks (slot, rank, rank within the slot's ``values``). Values are cut into ranges; only ranges with a wanted rank are ordered."""
    spark = values.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 512)
    values = values.withColumn("_bucket", bucket_of(F.col("v"), split_points(values, "v", parts)))
    before = Window.partitionBy("slot").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sizes = values.groupBy("slot", "_bucket").agg(F.sum("n").alias("_size")).withColumn("_upto", F.sum("_size").over(before))
    wanted = F.broadcast(spark.createDataFrame(ranks, "slot int, rank long, inside long"))
    here = sizes.join(wanted, "slot").where("inside < _upto AND inside >= _upto - _size")
    here = here.select("slot", "_bucket", "rank", (F.col("inside") - F.col("_upto") + F.col("_size")).alias("inside"))
    open_ranges = F.broadcast(here.select("slot", "_bucket").distinct())
    order = Window.partitionBy("slot", "_bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.join(open_ranges, ["slot", "_bucket"]).withColumn("_last", F.sum("n").over(order))
    hits = ranked.join(F.broadcast(here), ["slot", "_bucket"]).where("inside < _last AND inside >= _last - n")
    return {(r.slot, r.rank): r.v for r in hits.select("slot", "rank", "v").collect()}


def summarise(df: DataFrame, numbers: Sequence[str] | None = None, texts: Sequence[str] | None = None) -> Summary:
    """Counts, moments, exact quantiles and text values of a table.

    Quantiles interpolate between neighbours. A column without values has count 0 and NULLs; an empty table has a row a column too.
    Infinite values count as values. Should an interval miss a rank, which a correct sketch excludes, the job stops.
    """
    spark = df.sparkSession
    numbers = numeric_columns(df) if numbers is None else list(numbers)
    texts = text_columns(df) if texts is None else list(texts)
    kinds, grid = dict(df.dtypes), _grid()
    found = {}
    for i, c in enumerate(df.columns):
        found[f"n{i}"] = F.count(_number(c) if kinds[c] in FLOATS else col(c))
    for i, c in enumerate(numbers):
        v = _number(c)
        found |= {f"c{i}": F.count(v), f"a{i}": F.avg(v), f"s{i}": F.stddev_samp(v), f"q{i}": F.percentile_approx(v, grid, ACCURACY)}
        found |= {f"l{i}": F.min(v), f"h{i}": F.max(v)}
    first = df.agg(F.count(F.lit(1)).alias("rows"), *[f.alias(name) for name, f in found.items()]).first()

    wanted, intervals = {}, []
    for i, c in enumerate(numbers):
        n = first[f"c{i}"]
        for name in QUANTILES if n else ():
            ranks = {r: w for q, r, w in _wanted(n) if q == name}
            points = [first[f"l{i}"], *first[f"q{i}"][1:-1], first[f"h{i}"]]
            wanted[len(intervals)] = ranks
            intervals.append((c, name, *_interval(list(ranks), n, grid, points)))
    counted = _counted(df, intervals, texts)

    quantile: dict[tuple[str, str], float] = {}
    if intervals:
        numeric = counted.where(F.col("slot") < len(intervals))
        below = {r.slot: r.n for r in numeric.where("v IS NULL").select("slot", "n").collect()}
        ranks = [(slot, r, r - below.get(slot, 0)) for slot, some in wanted.items() for r in some]
        at = _at_ranks(numeric.where("v IS NOT NULL"), ranks)
        if len(at) < len(ranks):
            raise RuntimeError("a quantile lies outside its interval")
        for slot, some in wanted.items():
            column, name = intervals[slot][:2]
            quantile[column, name] = sum(at[slot, r] * w for r, w in some.items())
    rows = [
        (c, first[f"c{i}"], first[f"a{i}"], first[f"s{i}"], first[f"l{i}"], *[quantile.get((c, q)) for q in QUANTILES], first[f"h{i}"])
        for i, c in enumerate(numbers)
    ]
    name_of = F.element_at(F.array(*map(F.lit, texts or [""])), F.col("slot") - len(intervals) + 1)
    return Summary(
        first["rows"],
        {c: first[f"n{i}"] for i, c in enumerate(df.columns)},
        spark.createDataFrame(rows, STATISTICS),
        counted.where(F.col("slot") >= len(intervals)).select(name_of.alias("column"), F.col("t").alias("value"), "n"),
    )


def completeness(s: Summary, df: DataFrame) -> DataFrame:
    """``column, non_null, rows, cells, non_null_total, pct_total``."""
    cells, total = s.rows * len(s.non_null), sum(s.non_null.values())
    rows = [(c, n, s.rows, cells, total, total / cells * 100 if cells else None) for c, n in s.non_null.items()]
    return df.sparkSession.createDataFrame(rows, "column string, non_null long, rows long, cells long, non_null_total long, pct_total double")


def value_shares(s: Summary) -> DataFrame:
    """``column, value, n, share`` of every value of the text columns, NULL included."""
    return s.texts.withColumn("share", F.col("n") / F.lit(float(s.rows or 1)))


def n_unique(s: Summary) -> DataFrame:
    """``column, n_unique`` without NULL; the values are unique already."""
    return s.texts.groupBy("column").agg(F.count("value").alias("n_unique"))
