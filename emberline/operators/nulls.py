"""Where feature tables have no values: one join of each with the labelled points, and everything counted from what it leaves.

Before they meet the points, feature tables are cut down to their key and the names of the columns without a value. A joined row is
then a narrow *fact*; facts are written once, and the patterns of missing columns by class and month, a table that does not grow
with the rows, answer most questions.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators import merge
from emberline.operators.lineage import settle, settle_all
from emberline.operators.quality import histograms, missing

CLASS, AREA = "final", "area_ha"


def _missing(df: DataFrame, columns: Sequence[str]) -> Column:
    """Names of the columns without a value, in the order given."""
    if not columns:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(missing(df, c), F.lit(c)) for c in columns]))


class NullAudit:
    """Null counts of ``features`` at the points of ``labels`` (``keys``, class, area); all dates are whole days already.

    Points and features may repeat a key, and NULL keys equal each other. A feature may have columns of any name.
    """

    def __init__(self, labels: DataFrame, features: dict[str, DataFrame], keys: Sequence[str]):
        self.keys, self.names = list(keys), sorted(features)
        self.columns = {name: [*keys, *[c for c in features[name].columns if c not in (*keys, CLASS)]] for name in self.names}
        area = F.col(AREA) if AREA in labels.columns else F.lit(None)
        self.points = settle(
            merge.keyed(labels.select(*keys, CLASS, area.cast("double").alias(AREA)), keys).withColumn("month", F.month("date")), "audit-points"
        )
        narrow = [
            merge.keyed(features[n], keys).select(merge.MERGE_KEY, _missing(features[n], self.columns[n][len(self.keys) :]).alias("_missing"))
            for n in self.names
        ]
        sides = settle_all(narrow, "audit-side")
        facts = [self._facts(n, joined) for n, joined in zip(self.names, merge.inner_joins(self.points, sides))]
        self.facts = settle(reduce(DataFrame.union, facts), "audit-facts")
        self.patterns = settle(
            self.facts.groupBy("feature", CLASS, "month", "missing").agg(F.count(F.lit(1)).alias("n")), "audit-patterns"
        )

    def _facts(self, name: str, joined: DataFrame) -> DataFrame:
        """Rows with a NULL keep their key and area; of the others only class and month are left."""
        found = F.concat(_missing(joined, self.keys), F.col("_missing"))
        kept = [F.when(F.size("missing") > 0, F.col(c)).alias(c) for c in (*self.keys, AREA)]
        return joined.withColumn("missing", found).select(F.lit(name).alias("feature"), CLASS, "month", "missing", *kept)

    def by_column(self) -> DataFrame:
        """``feature, final, column, nulls, rows, rows_with_null, pct_rows_with_null``."""
        some = F.when(F.size("missing") > 0, F.col("n")).otherwise(0)
        classes = self.patterns.groupBy("feature", CLASS).agg(F.sum("n").alias("rows"), F.sum(some).alias("rows_with_null"))
        listed = [F.when(F.col("feature") == n, F.array(*map(F.lit, self.columns[n]))) for n in self.names]
        every = classes.withColumn("column", F.explode(F.coalesce(*listed)))
        nulls = self.patterns.withColumn("column", F.explode("missing")).groupBy("feature", F.col(CLASS).alias("_class"), "column")
        met = every.join(
            nulls.agg(F.sum("n").alias("nulls")).withColumnsRenamed({"feature": "_feature", "column": "_column"}),
            (F.col("feature") == F.col("_feature")) & F.col(CLASS).eqNullSafe(F.col("_class")) & (F.col("column") == F.col("_column")),
            "left",
        )
        pct = F.col("rows_with_null") / F.col("rows") * 100
        nulls = F.coalesce("nulls", F.lit(0).cast("long")).alias("nulls")
        return met.select("feature", CLASS, "column", nulls, "rows", "rows_with_null", pct.alias("pct_rows_with_null"))

    def by_month(self) -> DataFrame:
        """``feature, final, month, rows, rows_with_null, pct``: rows with a NULL against all points of the month, whatever their class."""
        month = Window.partitionBy("month")
        counted = self.points.groupBy(CLASS, "month").agg(F.count(F.lit(1)).alias("n")).withColumn("rows", F.sum("n").over(month))
        every = counted.select(F.explode(F.array(*map(F.lit, self.names))).alias("feature"), CLASS, "month", "rows")
        nulls = self.patterns.where(F.size("missing") > 0).groupBy(
            F.col("feature").alias("_feature"), F.col(CLASS).alias("_class"), F.col("month").alias("_month")
        )
        same = (F.col("feature") == F.col("_feature")) & F.col(CLASS).eqNullSafe(F.col("_class")) & F.col("month").eqNullSafe(F.col("_month"))
        met = every.join(nulls.agg(F.sum("n").alias("_n")), same, "left").withColumn("rows_with_null", F.coalesce("_n", F.lit(0).cast("long")))
        return met.select("feature", CLASS, "month", "rows", "rows_with_null", (F.col("rows_with_null") / F.col("rows") * 100).alias("pct"))

    def rows(self) -> DataFrame:
        """Every joined row with a NULL: ``feature, final``, its key, and the names of the columns, comma-joined."""
        return self.facts.where(F.size("missing") > 0).select("feature", CLASS, *self.keys, F.array_join("missing", ",").alias("missing"))

    def areas(self, final: int = 1, bins: int = 15) -> DataFrame:
        """``feature, bin, low, high, n``: burned areas of the class's rows with a NULL, in equal bins from the least to the greatest."""
        chosen = self.facts.where((F.size("missing") > 0) & (F.col(CLASS) == final))
        return histograms(chosen, "feature", AREA, bins)

    def overlap(self) -> DataFrame:
        """``final, month, features, points``: how many different places and days lack values in just these features."""
        lacking = self.facts.where(F.size("missing") > 0).select("feature", CLASS, "month", *self.keys).distinct()
        points = lacking.groupBy(CLASS, "month", *self.keys).agg(F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("features"))
        return points.groupBy(CLASS, "month", "features").agg(F.count(F.lit(1)).alias("points"))
