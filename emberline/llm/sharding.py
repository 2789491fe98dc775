"""Shards from a fixed number of virtual slots.

Records are hashed into slots; the bytes of every slot are added up; a stored, versioned map says which shard holds a
slot. Rebalancing edits the map: slots stay where they are as long as their shard is not over its share, and only what is
over moves, together with slots that have no shard yet, each to the lightest shard, the heaviest slots first. A
document moves only if its slot does.

The law kept is ``bytes``: the sizes of the shards are near equal. Everything is DataFrame functions; the map
has ``SLOTS`` rows, whatever the size of the corpus.

Edge cases: a NULL text has size 1; rows with NULL ids are spread by their texts; repeated rows share a slot, each with
a number of its own; an empty table gives an empty result and an even map.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.operators.lineage import settle

SLOTS = 4096
#: Rows numbered in one window.
NUMBER_GROUP = 50_000
MAP = "version int, slot int, shard int, bytes long"


def size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def slot_of(doc_id: Column, text_crc32: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text_crc32), F.lit(slots)).cast("int")


def slot_bytes(spark: SparkSession, sized: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``slot, bytes`` of all slots, those without records too."""
    sums = sized.groupBy("slot").agg(F.sum("size").alias("bytes"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(sums, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _lightest(moving: Column, loads: Column) -> Column:
    """Shards for ``moving`` (bytes, slot), in order: each goes to the lightest."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))

    def step(state: Column, x: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        more = F.transform(state["loads"], lambda load, i: F.when(i == at, load + x["bytes"] + 1).otherwise(load))
        return F.struct(more.alias("loads"), F.concat(state["to"], F.array(at)).alias("to"))

    return F.aggregate(moving, start, step, lambda state: state["to"])


def edit_map(weights: DataFrame, shards: int, previous: DataFrame | None = None) -> DataFrame:
    """The next version of the map for ``weights`` (slot, bytes); without ``previous``, version 1.

    Shards that the new number no longer has lose all their slots; new ones start empty.
    """
    if previous is None:
        held = weights.select("slot", "bytes", F.lit(None).cast("int").alias("shard"), F.lit(0).alias("version"))
    else:
        old = previous.select("slot", F.when(F.col("shard") < shards, F.col("shard")).alias("shard"), "version")
        held = weights.join(F.broadcast(old), "slot", "left")
    total = F.sum(F.col("bytes") + 1).over(Window.partitionBy())
    heavy_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    held = held.withColumns({"_share": F.ceil(total / shards), "_sum": F.sum(F.col("bytes") + 1).over(heavy_first)})
    held = held.withColumn("_stays", F.col("shard").isNotNull() & (F.col("_sum") <= F.col("_share")))
    moving = F.reverse(F.sort_array(F.collect_list(F.when(~F.col("_stays"), F.struct("bytes", "slot")))))
    loads = [F.coalesce(F.sum(F.when(F.col("_stays") & (F.col("shard") == s), F.col("bytes") + 1)), F.lit(0)) for s in range(shards)]
    staying = F.collect_list(F.when(F.col("_stays"), F.struct("slot", "shard", "bytes")))
    one = held.agg(
        moving.alias("moving"), F.array(*loads).alias("loads"), staying.alias("staying"), (F.max("version") + 1).alias("version")
    )
    moved = F.zip_with(
        "moving", _lightest(F.col("moving"), F.col("loads")), lambda x, to: F.struct(x["slot"], to.alias("shard"), x["bytes"])
    )
    return one.select("version", F.inline(F.concat("staying", moved))).select("version", "slot", "shard", "bytes")


def save_map(slot_map: DataFrame, root: str) -> None:
    """Add a version to the stored maps; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(root)


def load_map(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest unless one is named."""
    stored = spark.read.schema(MAP).parquet(root)
    wanted = stored.agg(F.max("version")).first()[0] if version is None else version
    return stored.where(F.col("version") == wanted)


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32`` and the virtual ``slot`` of every record."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(doc_id).alias("doc_id"), size(F.col(text)).alias("size"), crc.alias("text_crc32")).withColumn(
        "slot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots)
    )


def numbered(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` (with ``slot`` and a unique ``_row``) with their ``shard`` and their ``number`` in it, gapless from 0."""
    n, slots = rows.count(), max(1, slot_map.count())
    groups = max(1, math.ceil(n / (slots * NUMBER_GROUP)))
    own = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    place = F.broadcast(slot_map.select("slot", "shard"))
    before = Window.partitionBy("shard").orderBy("slot", "_group").rowsBetween(Window.unboundedPreceding, -1)
    first = own.groupBy("slot", "_group").agg(F.count(F.lit(1)).alias("_n")).join(place, "slot")
    first = first.select("slot", "_group", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("slot", "_group").orderBy("_row")
    return own.join(first, ["slot", "_group"]).withColumn("number", F.col("_first") + F.row_number().over(order) - 1)


def shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", previous: DataFrame | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, shard, number`` and the map's ``version`` for every record."""
    spark = docs.sparkSession
    rows = settle(sized(docs, doc_id, text).withColumn("_row", F.monotonically_increasing_id()), "sized")
    slot_map = settle(edit_map(slot_bytes(spark, rows), shards, previous), "slot-map")
    version = slot_map.agg(F.max("version")).first()[0]
    return numbered(rows, slot_map).select(
        "doc_id", "size", "text_crc32", F.col("slot").alias("virtual_slot"), "shard", "number", F.lit(version).alias("version")
    )
