"""Links between values that share a key, without writing out the pairs of a group.

Rows are dealt by key and sorted; a task streams through its groups and writes, for each connected part of a group, one
link from its first member to every other: at most one row per member, however many pairs are linked. Groups over
``limit`` rows are not held by one task: they are cut into blocks, and every pair of blocks is a group of its own.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import arrow_schema, scan, ship
from emberline.operators import cluster
from emberline.operators.lineage import settle

ship(__name__)

LIMIT = 4096
CHUNK = 64
#: (values, some, others) -> matrix: is values[some[i]] linked with values[others[j]]?
Linked = Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray]


def group_links(values: pa.Array, linked: Linked) -> Iterator[tuple[int, np.ndarray]]:
    """For each connected part of a group its first member and the others. Found members are not compared again."""
    left = np.arange(len(values))
    while len(left):
        seed, left = left[0], left[1:]
        frontier, found = np.array([seed]), []
        while len(frontier) and len(left):
            some, frontier = frontier[:CHUNK], frontier[CHUNK:]
            hit = linked(values, some, left).any(axis=0)
            found.append(left[hit])
            frontier, left = np.concatenate([frontier, left[hit]]), left[~hit]
        others = np.concatenate(found) if found else left[:0]
        if len(others):
            yield seed, others


def _streamed(linked: Linked, limit: float, out: pa.Schema) -> Callable:
    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node = t["key"].to_numpy(), t["node"].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        a, b = [], []
        value = t["value"].combine_chunks()
        for start, n in zip(edge[:-1][(many := np.diff(edge) > 1)].tolist(), np.diff(edge)[many].tolist()):
            for seed, others in group_links(value.slice(start, n), linked):
                a.append(np.full(len(others), node[start + seed]))
                b.append(node[start + others])
        if a:
            ends = pa.array(np.concatenate(a)), pa.array(np.concatenate(b))
            none = [pa.nulls(len(ends[0]), f.type) for f in out][2:]
            yield pa.RecordBatch.from_arrays([*ends, *none], schema=out)

    def rest(t: pa.Table) -> Iterator[pa.RecordBatch]:
        none = pa.nulls(t.num_rows, pa.int64())
        yield from pa.Table.from_arrays([none, none, t["key"], t["node"], t["value"]], schema=out).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        large = None  # the key of a group that is passed on as it comes
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            key = t["key"].to_numpy()
            if large is not None:
                n = int(np.searchsorted(key, large, side="right"))
                yield from rest(t.slice(0, n))
                t, key = t.slice(n), key[n:]
                large = large if not len(key) else None
            if not len(key):
                held = None
                continue
            last = int(np.searchsorted(key, key[-1]))
            edge = np.flatnonzero(np.concatenate([[True], key[:last][1:] != key[:last][:-1], [True]])) if last else np.zeros(1, int)
            over = np.flatnonzero(np.diff(edge) > limit)
            at = 0
            for o in over.tolist():
                yield from links(t.slice(at, int(edge[o]) - at)) if edge[o] > at else ()
                yield from rest(t.slice(int(edge[o]), int(edge[o + 1] - edge[o])))
                at = int(edge[o + 1])
            if last > at:
                yield from links(t.slice(at, last - at))
            held = t.slice(last)
            if held.num_rows > limit:
                yield from rest(held)
                held, large = None, key[-1]
        if held is not None and held.num_rows > 1:
            yield from links(held)

    return run


def _by_key(keyed: DataFrame, linked: Linked, limit: float) -> DataFrame:
    kind = keyed.schema["value"].dataType.simpleString()
    ddl = f"a long, b long, key long, node long, value {kind}"
    dealt = keyed.select("key", "node", "value").repartition("key").sortWithinPartitions("key")
    return scan(dealt, _streamed(linked, limit, arrow_schema(ddl)), ddl)


def links(keyed: DataFrame, linked: Linked, limit: int = LIMIT) -> DataFrame:
    """Links ``a, b`` with the same connected parts as all linked pairs of ``key, node, value`` rows with equal keys."""
    found = settle(_by_key(keyed, linked, limit), "links")
    large = found.where("key IS NOT NULL").select("key", "node", "value")
    some = found.where("a IS NOT NULL").select("a", "b")
    if large.isEmpty():
        return some
    blocks = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("_k"))
    own = F.pmod(F.xxhash64("node"), F.col("_k")).cast("int")
    pairs = (
        large.join(blocks, "key")
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "node", "value")
    )
    return some.union(settle(_by_key(pairs, linked, math.inf).select("a", "b"), "block-links"))


def roots(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b)."""
    return settle(cluster.contract(settle(edges.distinct(), "edges"))[0].select("node", "root"), "roots")
