"""What several operators of this subpackage share."""

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from emberline.operators.lineage import settle

#: White space that separates words, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]"


def ship(module: str) -> None:
    """Send a module's functions with the tasks, so that executors need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words between white space; empty for a NULL text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(docs: DataFrame, *apart: str) -> Column:
    """All columns but those ``apart`` as one struct, its fields named by number, so that no name clashes with an operator's own."""
    fields = [quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in apart]
    return F.struct(F.lit(0).alias("none"), *fields).alias("_row")


def taken_back(docs: DataFrame, *apart: str) -> dict[str, Column]:
    """The columns in ``carried``, by name."""
    return {c: F.col(f"_row.c{i}") for i, c in enumerate(docs.columns) if c not in apart}


def scan(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """One pass over the partitions of ``df`` in Arrow batches."""
    return df.mapInArrow(fn, schema)


def rows(batches: Iterable[pa.RecordBatch], *columns: str, size: int = 512) -> Iterator[list]:
    """Columns of a batch as Python lists, ``size`` rows at a time: long texts are not all unpacked at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def worker_state(name: str, make: Callable[[], object]) -> object:
    """A value that later tasks of the same worker process find again."""
    home = sys.modules.setdefault("_emberline_worker", type(sys)("_emberline_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


#: Bits of a filter that goes to all tasks: 4 MB, whatever the size of the corpus.
FILTER_BITS = 25


def _filter_words(keys: Column) -> tuple[Column, Column]:
    slot = F.pmod(keys, F.lit(1 << FILTER_BITS))
    return F.floor(slot / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A bit set of the keys' hashes; it only saves work, what passes is joined exactly."""
    word, bit = _filter_words(F.col(key))
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for batch in keys.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_batches():
        words[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return words


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64 bits each) a ``key_filter`` lets through."""
    slot = keys.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
    return (words.view(np.uint64)[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _placed(group: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            key = batch.column(group).to_numpy()
            if not len(key):
                continue
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            place = np.arange(len(key)) - np.repeat(edge, np.diff(np.append(edge, len(key))))
            if key[0] == last:
                place[: edge[1] if len(edge) > 1 else len(key)] += n
            last, n = key[-1], int(place[-1]) + 1
            columns = [*batch.columns, pa.array(place), pa.array(np.full(len(key), shard))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def number(df: DataFrame, group: str, order: list) -> DataFrame:
    """``df`` with ``place``: the rows of each ``group`` (a long, not NULL) numbered from 0 in ``order``.

    The rows are range-sorted by all of that, so a large group lies in several tasks, each of which numbers its own share.
    What a group has in the tasks before is a row per task at most. Rows that are equal in ``order`` may lie in several
    tasks and take their numbers in any order.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = df.withColumn("_copy", F.monotonically_increasing_id())
    dealt = copies.repartitionByRange(tasks, group, *order, "_copy").sortWithinPartitions(group, *order).drop("_copy")
    schema = StructType(df.schema.fields).add("place", "long").add("shard", "long")
    local = settle(dealt.mapInArrow(_placed(df.columns.index(group), to_arrow_schema(schema)), schema), "numbered")
    shares = local.groupBy(group, "shard").agg((F.max("place") + 1).alias("_n"))
    split = shares.join(shares.groupBy(group).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1"), group, "left_semi")
    earlier = Window.partitionBy(group).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = split.select(group, "shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # Two rows at most for every task of the sort.
    return (
        local.join(F.broadcast(offset), [group, "shard"], "left")
        .withColumn("place", F.col("place") + F.coalesce("_before", F.lit(0)))
        .drop("shard", "_before")
    )
