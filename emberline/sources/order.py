"""The order that rows have in their files, as a column, whatever splits Spark reads them in.

Files count in order of their paths, rows in the order they stand in their file. Numbers are dense, from 0.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.lineage import settle

FILE, BLOCK, ROW = "_source_file", "_source_block", "_source_row"


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with FILE, BLOCK, ROW (from 0 in its block): add up the rows of the blocks before.

    Sixteen bytes a block go to all tasks, a block being a file or a split of one, and one task adds up their counts.
    """
    block = F.xxhash64(FILE, BLOCK)
    sizes = settle(rows.groupBy(FILE, BLOCK).agg((F.max(ROW) + 1).alias("_n")).withColumn("_block", block), "source-blocks")
    if sizes.select("_block").distinct().count() < sizes.count():
        raise RuntimeError("two blocks have one hash; rename a file")
    before = Window.orderBy(FILE, BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    met = rows.withColumn("_block", block).join(F.broadcast(base), "_block")
    return met.withColumn(order, (F.col("_base") + F.col(ROW)).cast("long")).drop("_block", "_base", FILE, BLOCK, ROW)


def number_parquet(scanned: DataFrame, order: str = "ord") -> DataFrame:
    """A Parquet scan with its source order. Files know their row numbers; counting rows reads no column."""
    placed = scanned.select(
        "*", F.col("_metadata.file_path").alias(FILE), F.lit(0).cast("long").alias(BLOCK), F.col("_metadata.row_index").alias(ROW)
    )
    return _numbered(placed, order)


def number_text(scanned: DataFrame, order: str = "ord") -> DataFrame:
    """A CSV scan with its source order, read once into a written table.

    A split lies in one task, which reads it from its beginning, so running numbers tell the order inside a split.
    """
    at = scanned.select(
        "*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), F.monotonically_increasing_id().alias(ROW)
    )
    held = settle(at, "source-rows")
    first = settle(held.groupBy(FILE, BLOCK).agg(F.min(ROW).alias("_first")).withColumn("_split", F.xxhash64(FILE, BLOCK)), "source-splits")
    begun = held.withColumn("_split", F.xxhash64(FILE, BLOCK)).join(F.broadcast(first.select("_split", "_first")), "_split")
    return _numbered(begun.withColumn(ROW, F.col(ROW) - F.col("_first")).drop("_split", "_first"), order)
