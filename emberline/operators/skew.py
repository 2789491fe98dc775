"""Joins and row generation that stay balanced when one key holds a large share of the rows.

A key is *hot* if it holds more than 1/256 of a side, so a side has fewer than 256 hot keys whatever its
size. That bound is what makes the broadcasts below safe.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.operators.lineage import settle

HOT_SHARE = 256
BROADCAST_ROWS = 200_000
#: Besides, a table goes to all tasks only up to this size: the driver holds it several times over, as rows, as a hash table and in blocks.
BROADCAST_BYTES = 4 << 20
#: Of a row in a hash table besides its columns, of a column, and of a text or array unless its size is known.
ROW_BYTES, VALUE_BYTES, LONG_BYTES = 40, 8, 64
SALTS = 8
CHUNK = 8_192
MIN_TASK_ROWS, MAX_TASK_ROWS = 50_000, 2_000_000
BUCKETS = 4_096


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, for tables that grow with the data.

    Spark takes a table to be as large as the files it is read from: compressed, and before any ``explode``. A side that looks
    small by that would go whole through the driver's memory.
    """
    return df.hint("merge")


def row_bytes(df: DataFrame) -> int:
    """About the size of a row of ``df`` in a hash table."""
    long = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    return ROW_BYTES + sum(LONG_BYTES if isinstance(f.dataType, long) else VALUE_BYTES for f in df.schema)


def few(df: DataFrame, rows: int, weight: int = 1) -> bool:
    """Whether ``rows`` rows of ``df``, each as large as ``weight`` ordinary ones, may go to all tasks."""
    return rows * weight <= BROADCAST_ROWS and rows * weight * row_bytes(df) <= BROADCAST_BYTES


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def key_counts(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int, int]:
    """Rows per key (combined before the shuffle), number of keys, number of rows."""
    counts = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), "key-counts")
    n_keys, n_rows = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    return counts, n_keys, n_rows


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    right_rows: int | None = None,
    counts: tuple[DataFrame, int, int] | None = None,
    weight: int = 1,
) -> DataFrame:
    """Join to a table with one row per key. ``how`` is ``left`` or ``inner``.

    ``right_rows`` is the known size of ``right``, ``counts`` the known ``key_counts`` of ``left``, ``weight``
    the size of a right row in ordinary rows.
    A right side of few rows, and few bytes, is broadcast. Otherwise only the keys that ``left`` really uses are fetched;
    if these are few they are broadcast, else the rows of hot keys (and of NULL keys, which match nothing)
    get their answers from a broadcast of fewer than 256 rows and stay where they are, and the rest is
    shuffled.
    """
    keys = list(keys)
    if right_rows is not None and few(right, right_rows, weight):
        return left.join(F.broadcast(right), keys, how)
    counts, n_keys, n_rows = counts or key_counts(left, keys)
    asked = counts.select(*keys, "_rows")
    if few(right, n_keys, weight):
        return left.join(F.broadcast(asked.join(right, keys, "inner").drop("_rows")), keys, how)
    used = shuffled(asked).join(right, keys, "inner")
    is_hot = F.col("_rows") > n_rows / HOT_SHARE
    hot_keys = counts.where(is_hot).select(*keys, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(hot_keys), keys, "left")
    stay = F.coalesce(F.col("_hot"), F.lit(False)) | _any_null(keys)
    hot = marked.where(stay).drop("_hot").join(F.broadcast(used.where(is_hot).drop("_rows")), keys, how)
    cold = marked.where(~stay).drop("_hot").join(used.where(~is_hot).drop("_rows"), keys, how)
    # Written out: both branches read ``left``, so a chain of lookups would otherwise double per link.
    return settle(hot.unionByName(cold), "looked-up")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys equal each other; the left side's keys are kept."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def _collapse(df: DataFrame, name: str) -> DataFrame:
    """Equal rows become one row with their number: copies shrink before any shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(name))


def bucket_sizes(df: DataFrame, keys: Sequence[str]) -> dict[int, int]:
    """Rows per hash bucket of the key: at most BUCKETS numbers, whatever the data."""
    return {r[0]: r[1] for r in df.groupBy(_bucket(keys).alias("b")).count().collect()}


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_keys(df: DataFrame, keys: Sequence[str], sizes: dict[int, int] | None = None) -> DataFrame | None:
    """Keys with more than 1/HOT_SHARE of the rows (and more than CHUNK rows), or None.

    A hot key makes its bucket heavy, so only heavy buckets, usually none, have their keys counted.
    """
    sizes = bucket_sizes(df, keys) if sizes is None else sizes
    limit = max(sum(sizes.values()) / HOT_SHARE, CHUNK)
    heavy = [b for b, n in sizes.items() if n > limit]
    if not heavy:
        return None
    counts = df.where(_bucket(keys).isin(heavy)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") > limit).select(*keys)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    left_sizes: dict[int, int] | None = None,
) -> DataFrame:
    """Equi-join, NULL keys equal each other, any number of rows per key on both sides.

    Without hot keys it is a plain join. Rows of hot keys are collapsed to distinct rows with a count and
    spread over a SALTS x SALTS grid, each side repeated along one axis, so that no task sees more than
    1/SALTS of either side's rows of a key; the counts are multiplied out afterwards.
    ``left_sizes`` are the ``bucket_sizes`` of ``left`` if known.
    """
    keys = list(keys)
    found = [k for k in (hot_keys(left, keys, left_sizes), hot_keys(right, keys)) if k is not None]
    hot = settle(reduce(DataFrame.unionByName, found).distinct(), "hot-keys") if found else None
    if hot is None or hot.isEmpty():
        return _null_safe(left, right, keys, how)

    hot = F.broadcast(hot)
    cold = _null_safe(_null_safe(left, hot, keys, "left_anti"), _null_safe(right, hot, keys, "left_anti"), keys, how)
    hot_left = _null_safe(left, hot, keys, "left_semi")
    hot_right = _null_safe(right, hot, keys, "left_semi")
    l, r = _collapse(hot_left, "_n_left"), _collapse(hot_right, "_n_right")
    axis = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    l = l.withColumn("_i", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).withColumn("_j", axis)
    r = r.withColumn("_j", F.pmod(F.xxhash64(*right.columns), F.lit(SALTS)).cast("int")).withColumn("_i", axis)
    pairs = _null_safe(l, r, [*keys, "_i", "_j"], "inner").withColumn("_n", F.col("_n_left") * F.col("_n_right"))
    out = cold.unionByName(repeat_rows(pairs, "_n", "_k").select(*cold.columns))
    if how == "left":
        answered = F.broadcast(hot_right.select(*keys).distinct())
        out = out.unionByName(_null_safe(hot_left, answered, keys, "left_anti"), allowMissingColumns=True)
    return settle(out, "joined")


def repeat_rows(df: DataFrame, n_col: str, index: str, total: int = 0) -> DataFrame:
    """``n`` copies of each row, numbered from 0 in ``index``; rows with ``n < 1`` vanish.

    A row with a huge ``n`` is first cut into chunks that are spread over all tasks. The number of tasks is
    set outright, from the expected ``total`` if known: adaptive merging would judge the chunks by their own
    small size and not by what they turn into.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if total:
        tasks = max(min(tasks, -(-total // MIN_TASK_ROWS)), total // MAX_TASK_ROWS)
    n = F.col(n_col)
    size = F.lit(CHUNK).cast("long")
    chunks = df.where(n > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size).cast("long")))
    )
    spread = chunks.repartition(tasks, *[F.col(c) for c in chunks.columns])
    start = F.col("_chunk") * size
    return spread.withColumn(index, F.explode(F.sequence(start, F.least(n, start + size) - 1))).drop("_chunk")
