"""Left joins of any number of tables on one key, each table shuffled once at most.

The parts of the key become one text that is never NULL, so NULLs meet each other by plain equality and every join of the
chain asks for the same partitioning: the joined rows stay where the first exchange put them. Tables that are stored in
buckets of that text meet without any exchange. How heavy the keys are is counted once, for all tables together, before the
joins; rows of hot keys, usually none, take another way.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import skew
from emberline.operators.lineage import settle, settle_all

MERGE_KEY = "_merge_key"
#: Values (rows times columns) of a right side that go to all tasks.
BROADCAST_VALUES = 8 * skew.BROADCAST_ROWS


def key_text(df: DataFrame, keys: Sequence[str]) -> Column:
    """The key as one text: equal where the parts are equal or both NULL. Numbers are compared as doubles."""
    kinds = dict(df.dtypes)

    def part(k: str) -> Column:
        numeric = kinds[k] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[k].startswith("decimal")
        value = (F.col(k).cast("double") + F.lit(0.0)) if numeric else F.col(k)  # -0.0 is 0.0
        return F.coalesce(value.cast("string"), F.lit("~"))

    return F.concat_ws("|", *[part(k) for k in keys])


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn(MERGE_KEY, key_text(df, keys))


def store_bucketed(df: DataFrame, keys: Sequence[str], table: str, path: str, buckets: int) -> None:
    """Store ``df`` as ``table`` at ``path``, in ``buckets`` by its key, replacing what was there."""
    one_file_each = keyed(df, keys).repartition(buckets, MERGE_KEY)
    one_file_each.write.mode("overwrite").bucketBy(buckets, MERGE_KEY).sortBy(MERGE_KEY).option("path", path).saveAsTable(table)


def read_bucketed(spark: SparkSession, tables: Sequence[str]) -> list[DataFrame]:
    return [spark.table(t) for t in tables]


def _weights(tables: Sequence[DataFrame]) -> list[dict[int, int]]:
    """Rows per hash bucket of the key, per table: BUCKETS numbers a table, from one job that reads the keys only."""
    parts = [t.select(F.lit(i).alias("i"), skew._bucket([MERGE_KEY]).alias("b")) for i, t in enumerate(tables)]
    out: list[dict[int, int]] = [{} for _ in tables]
    for r in reduce(DataFrame.union, parts).groupBy("i", "b").count().collect():
        out[r[0]][r[1]] = r[2]
    return out


def _hot(tables: Sequence[DataFrame], weights: Sequence[dict[int, int]]) -> DataFrame | None:
    """Keys that are hot in any table."""
    found = [k for t, sizes in zip(tables, weights) if (k := skew.hot_keys(t, [MERGE_KEY], sizes)) is not None]
    hot = settle(reduce(DataFrame.union, found).distinct(), "hot-merge-keys") if found else None
    return None if hot is None or hot.isEmpty() else hot


def suffixed(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Columns that both tables have, but for the key, end in ``_x`` and ``_y``."""
    shared = set(left.columns) & set(right.columns) - set(keys)
    return tuple(df.withColumnsRenamed({c: c + end for c in shared}) for df, end in ((left, "_x"), (right, "_y")))


def _chain(tables: Sequence[DataFrame], join) -> DataFrame:
    return reduce(lambda a, b: join(*suffixed(a, b, [MERGE_KEY])), tables)


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, MERGE_KEY, "left")


def _met_hot(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of a few hot keys: a small right side goes to where the left rows are, a large one is spread with them."""
    if right.count() * len(right.columns) <= BROADCAST_VALUES:
        return left.join(F.broadcast(right), MERGE_KEY, "left")
    return skew.skew_join(left, right, [MERGE_KEY], "left")


def merge_keyed(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The ``tables`` (with ``MERGE_KEY``) left-joined to the first one."""
    columns = [tables[0], *[t.drop(*keys) for t in tables[1:]]]
    hot = _hot(tables, _weights(tables))
    if hot is None:
        return _chain(columns, _met).drop(MERGE_KEY)
    one = F.broadcast(hot)
    cold = _chain([t.join(one, MERGE_KEY, "left_anti") for t in columns], _met)
    heavy = _chain([t.join(one, MERGE_KEY, "left_semi") for t in columns], _met_hot)
    return cold.unionByName(heavy).drop(MERGE_KEY)


def merge(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left joins on ``keys`` to the first table, any number of rows per key on all sides; NULLs equal each other.

    Every table is worked out once, into a written table; counting keys and joining read that. Shared columns beside the key
    end in ``_x`` and ``_y``.
    """
    return merge_keyed(settle_all([keyed(t, keys) for t in tables], "merge-input"), keys)


def inner_joins(left: DataFrame, rights: Sequence[DataFrame]) -> list[DataFrame]:
    """``left`` with each of ``rights`` on ``MERGE_KEY``, rows that match only. All are settled, and share no other column.

    The joins ask for the same partitioning of ``left``, so used together they shuffle it once.
    """
    hot = _hot([left, *rights], _weights([left, *rights]))
    if hot is None:
        return [left.join(r, MERGE_KEY) for r in rights]
    one = F.broadcast(hot)
    cold, heavy = left.join(one, MERGE_KEY, "left_anti"), left.join(one, MERGE_KEY, "left_semi")
    out = []
    for r in rights:
        met = skew.skew_join(heavy, r.join(one, MERGE_KEY, "left_semi"), [MERGE_KEY], "inner")
        out.append(cold.join(r.join(one, MERGE_KEY, "left_anti"), MERGE_KEY).unionByName(met))
    return out
