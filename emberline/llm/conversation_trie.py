"""The prefix trie of conversations, from padded matrices of turn ids.

A conversation is cut into pieces of ``WIDTH`` turns. A piece carries the hash of all turns before it, so the pieces of one
level that begin at the same node have equal hashes, and no row grows with a conversation. Pieces are dealt to tasks by
ranges of (level, node where they begin, turn ids). A task sorts its pieces lexicographically as a padded matrix of turn ids;
a change in a column, or in any column before it, starts a node there; sums over the rows of each node are reductions between
starts, one column (depth) at a time. Nodes that touch the ends of a task's range may go on in the neighbour's, and only those
are added up over tasks.

Everything a node reports about its subtree is a sum over the node's members. A node is owned by its smallest member. A member
owns the deepest part of its own path, from depth ``own`` on, so with ``total`` its bytes, ``owned`` its bytes from ``own`` on,
and ``leaf`` 1 if it owns a childless node:

* leaves = sum of ``leaf``;
* children = members with ``own`` one deeper than the node, and 1 if the owner goes on;
* bytes over members less bytes over distinct nodes = (sum of ``total`` - n * before) - (sum of ``owned`` of those that do not
  own the node + ``total`` of the owner - before), where ``before`` is the bytes above the node.

So the matrices are gone through twice: for owners, and for the sums. Texts are hashed where they are read and never move.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import arrow_schema, number, scan, ship
from emberline.operators.lineage import settle
from emberline.operators.skew import lookup

ship(__name__)

#: Turns in a piece: the columns of a matrix.
WIDTH = 32
#: Pieces of one conversation whose hashes are added up by one window.
PIECES = 1024
#: Rows of a matrix.
ROWS = 40_000
KEY = ["depth", "a", "b"]
NODES = "depth long, a long, b long, pa long, pb long, before long, open boolean, "
OWNERS = NODES + "n long, ends long, owner long"
SUMS = NODES + "n long, owner long, parent long, total long, owned long, leaves long, opened long, owner_total long, owner_length long"


# ---- one matrix -----------------------------------------------------------------------------------------


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _padded(values: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the rows of ``columns``, ascending with them."""
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(order), bool)
    for c in columns:
        change[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(change) + 1
    return out


def _nodes(t: pa.Table, reduce: Callable, whole: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Every node that pieces of ``t`` reach, with what ``reduce`` makes of the rows between starts."""
    level, a0, b0, bytes0, conv = (t[c].to_numpy() for c in ("level", "a0", "b0", "bytes0", "conv"))
    a, lengths = _ragged(t["a"])
    b, _ = _ragged(t["b"])
    size, _ = _ragged(t["size"])
    width = int(lengths.max(initial=0))
    ids = _padded(_dense(a, b), lengths, width)
    base = _dense(level, a0, b0)
    order = np.lexsort((conv, *ids.T[::-1], base))
    # Column 0 is where the piece begins, column d the state after d of its turns.
    path_a = np.bitwise_xor.accumulate(np.column_stack([a0, _padded(a, lengths, width)])[order], axis=1)
    path_b = np.bitwise_xor.accumulate(np.column_stack([b0, _padded(b, lengths, width)])[order], axis=1)
    above = np.cumsum(np.column_stack([bytes0, _padded(size, lengths, width)])[order], axis=1)
    ids, lengths, level, base, t = ids[order], lengths[order], level[order], base[order], t.take(pa.array(order))
    changed = np.concatenate([[True], base[1:] != base[:-1]])
    for column in range(-1, width):
        if column >= 0:
            changed = changed | np.concatenate([[True], ids[1:, column] != ids[:-1, column]])
            there = lengths > column
        else:
            there = level == 0  # the root
        starts = np.flatnonzero(changed)
        keep = there[starts]
        if not keep.any():
            continue
        ends = np.append(starts[1:], len(changed))
        open_ = np.full(len(starts), not whole) | (starts == 0) | (ends == len(changed))
        first = starts[keep]
        depth = level[first] * WIDTH + column + 1
        up = max(column, 0)
        at = [depth, path_a[first, column + 1], path_b[first, column + 1], path_a[first, up], path_b[first, up], above[first, up], open_[keep]]
        found = reduce(t, starts, level * WIDTH + column + 1, level * WIDTH + lengths)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*at, *(f[keep] for f in found))], schema=schema)


def _owner_sums(t: pa.Table, starts: np.ndarray, depth: np.ndarray, reached: np.ndarray) -> list[np.ndarray]:
    conv, last = t["conv"].to_numpy(), t["last"].to_numpy(zero_copy_only=False)
    add = np.add.reduceat
    return [add(np.ones(len(conv), np.int64), starts), add(((reached == depth) & last).astype(np.int64), starts), np.minimum.reduceat(conv, starts)]


def _member_sums(t: pa.Table, starts: np.ndarray, depth: np.ndarray, reached: np.ndarray) -> list[np.ndarray]:
    conv, own, up, total, owned, leaf, length = (t[c].to_numpy() for c in ("conv", "own", "up", "total", "owned", "leaf", "length"))
    owner = own <= depth
    parent = np.where(own < depth, conv, up)
    add = lambda x: np.add.reduceat(x.astype(np.int64), starts)
    return [
        add(np.ones(len(conv))), add(conv * owner), add(parent * owner), add(total), add(owned * ~owner), add(leaf),
        add(own == depth + 1), add(total * owner), add(length * owner),
    ]


def _matrices(reduce: Callable, limit: int, schema: pa.Schema) -> Callable:
    """A task's pieces in matrices of ``limit`` rows; where one is not enough, its nodes are left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, whole = 0, True
        for batch in batches:
            if n and n + batch.num_rows > limit:
                whole = False
                yield from _nodes(pa.Table.from_batches(held), reduce, whole, schema)
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from _nodes(pa.Table.from_batches(held), reduce, whole, schema)

    return run


# ---- pieces ---------------------------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """``conv, turn, id, size`` of every turn with a conversation: the SHA-256 of role and text, and the text's bytes."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("`conv_id` IS NOT NULL").select(
        F.col("`conv_id`").cast("long").alias("conv"),
        F.col("`turn`").cast("long").alias("turn"),
        F.sha2(named, 256).alias("id"),
        F.octet_length(text).cast("long").alias("size"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """``conv, place, id, size``: turns in order of (turn, NULL first; id), numbered from 0 in each conversation."""
    return number(turns, "conv", [F.asc_nulls_first("turn"), "id"]).select("conv", "place", "id", "size")


def pieces(paths: DataFrame, conversations: DataFrame) -> DataFrame:
    """Pieces of the ``paths`` (``conv, depth`` from 1, ``id``, ``size``); every one of ``conversations`` (``conv``) has a first.

    ``level, a0, b0, bytes0``: the piece's number and what lies above it; ``a, b, size``: a list each, a value a turn.
    """
    level = F.floor((F.col("depth") - 1) / WIDTH)
    hashed = paths.select("conv", level.alias("level"), F.struct("depth", F.xxhash64("depth", "id").alias("a"), F.xxhash64(F.lit(7), "id", "depth").alias("b"), "size").alias("turn"))
    found = hashed.unionByName(conversations.select("conv", F.lit(0).cast("long").alias("level"), F.lit(None).cast(hashed.schema["turn"].dataType).alias("turn")))
    of = lambda c: F.transform("turns", lambda t: t[c]).alias(c)
    xor = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    rows = found.groupBy("conv", "level").agg(F.array_sort(F.collect_list("turn")).alias("turns")).select("conv", "level", of("a"), of("b"), of("size"))
    rows = settle(
        rows.select("*", xor("a").alias("_a"), xor("b").alias("_b"), F.aggregate("size", F.lit(0).cast("long"), lambda x, y: x + y).alias("_bytes"))
        .withColumn("_block", F.floor(F.col("level") / PIECES)),
        "pieces",
    )
    # What lies above a piece: the pieces before it in its block, and the blocks before that.
    totals = rows.groupBy("conv", "_block").agg(F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b"), F.sum("_bytes").alias("_bytes"))
    zero = F.lit(0).cast("long")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_block, in_conv = before.partitionBy("conv", "_block").orderBy("level"), before.partitionBy("conv").orderBy("_block")
    above = lambda w: [F.coalesce(f(c).over(w), zero).alias(c + "0") for f, c in ((F.bit_xor, "_a"), (F.bit_xor, "_b"), (F.sum, "_bytes"))]
    blocks = totals.select("conv", "_block", *above(in_conv)).where("_block > 0")
    inner = rows.select("conv", "level", "_block", "a", "b", "size", *above(in_block))
    first = inner.where("_block = 0").select("conv", "level", "_block", "a", "b", "size", *[F.col(c).alias(c + "x") for c in ("_a0", "_b0", "_bytes0")])
    outer = blocks.select("conv", "_block", *[F.col(c).alias(c + "x") for c in ("_a0", "_b0", "_bytes0")])
    later = inner.where("_block > 0").join(outer, ["conv", "_block"]).select(
        "conv", "level", "_block", "a", "b", "size",
        F.col("_a0").bitwiseXOR(F.col("_a0x")).alias("_a0x"), F.col("_b0").bitwiseXOR(F.col("_b0x")).alias("_b0x"),
        (F.col("_bytes0") + F.col("_bytes0x")).alias("_bytes0x"),
    )
    every = first.unionByName(later)
    return every.select("conv", "level", F.col("_a0x").alias("a0"), F.col("_b0x").alias("b0"), F.col("_bytes0x").alias("bytes0"), "a", "b", "size")


# ---- the trie -------------------------------------------------------------------------------------------


def _folded(pieces: DataFrame, reduce: Callable, ddl: str, sums: dict[str, Column], limit: int, name: str) -> DataFrame:
    """Nodes from all matrices; those left open are added up."""
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartitionByRange(tasks, "level", "a0", "b0", "a", "conv")
    found = settle(scan(dealt, _matrices(reduce, limit, arrow_schema(ddl)), ddl), name)
    closed = found.where("NOT open").drop("open")
    # The place of a node says all about what is above it: any row's will do.
    place = [F.max(c).alias(c) for c in ("pa", "pb", "before")]
    joined = found.where("open").groupBy(*KEY).agg(*place, *[f.alias(c) for c, f in sums.items()])
    return closed.unionByName(joined)


def trie(paths: DataFrame, conversations: DataFrame, limit: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """``(nodes, ends)`` of the trie of ``paths`` (``conv, depth, id, size``), members being all ``conversations`` (``conv``, unique).

    ``nodes``: ``depth, a, b`` (the key: depth and hash of the path), ``conv_id`` (smallest member), ``parent_conv_id`` (NULL for
    the root), ``n_convs, n_children, n_leaves, saved_tokens``. ``ends``: the key of the node at which each ``conv`` ends.
    Without conversations both are empty. Equal conversations share all nodes; one that is the beginning of another ends at an
    inner node; one without turns ends at the root.
    """
    zero = F.lit(0).cast("long")
    cut = settle(pieces(paths, conversations), "placed-pieces")
    length = cut.groupBy("conv").agg(
        F.max(F.col("level") * WIDTH + F.size("a")).alias("length"),
        F.sum(F.aggregate("size", zero, lambda x, y: x + y)).alias("total"),
        F.max("level").alias("_top"),
    )
    length = settle(length, "lengths")
    marked = lookup(cut, length.select("conv", "_top"), ["conv"], "inner").withColumn("last", F.col("level") == F.col("_top")).drop("_top")
    marked = settle(marked, "marked-pieces")
    owners = settle(
        _folded(marked, _owner_sums, OWNERS, {"n": F.sum("n"), "ends": F.sum("ends"), "owner": F.min("owner")}, limit, "owners"), "owned-nodes"
    )
    own = owners.groupBy("owner").agg(
        F.min("depth").alias("own"),
        F.min_by(F.struct("pa", "pb", "before"), "depth").alias("up"),
        F.max_by(F.col("n") == F.col("ends"), "depth").alias("leaf"),
    )
    own = settle(own.select(F.col("owner").alias("conv"), "own", (F.col("own") - 1).alias("depth"), F.col("up.pa").alias("a"), F.col("up.pb").alias("b"), "up.before", "leaf"), "owns")
    parents = lookup(own, owners.select(*KEY, F.col("owner").alias("up")), KEY)
    members = length.join(parents.select("conv", "own", "up", "before", "leaf"), "conv", "left").select(
        "conv",
        "length",
        "total",
        F.coalesce("own", F.col("length") + 2).alias("own"),
        F.coalesce("up", zero).alias("up"),
        F.coalesce(F.col("total") - F.col("before"), zero).alias("owned"),
        F.coalesce(F.col("leaf").cast("long"), zero).alias("leaf"),
    )
    full = lookup(marked.drop("last"), settle(members, "members"), ["conv"], "inner")
    added = {c: F.sum(c) for c in ("n", "owner", "parent", "total", "owned", "leaves", "opened", "owner_total", "owner_length")}
    sums = _folded(full, _member_sums, SUMS, added, limit, "sums")
    nodes = sums.select(
        *KEY,
        F.col("owner").alias("conv_id"),
        F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        (F.col("opened") + (F.col("owner_length") > F.col("depth")).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("total") - F.col("n") * F.col("before") - F.col("owned") - F.col("owner_total") + F.col("before")).alias("saved_tokens"),
    )
    xor = lambda c: F.aggregate(c, zero, lambda x, y: x.bitwiseXOR(y))
    ends = marked.where("last").select(
        "conv",
        (F.col("level") * WIDTH + F.size("a")).alias("depth"),
        F.col("a0").bitwiseXOR(xor("a")).alias("a"),
        F.col("b0").bitwiseXOR(xor("b")).alias("b"),
    )
    return nodes, ends


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    names = [*KEY, "ends_sha256"]
    out = lambda: pa.RecordBatch.from_arrays([*(pa.array([k]) for k in key), pa.array([digest.hexdigest()])], names=names)
    done: list[pa.RecordBatch] = []
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(4)]
        edge = np.zeros(len(columns[0]), bool)
        for c in columns[:3]:
            edge[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(edge).tolist()
        for first, end in zip([0, *starts], [*starts, len(edge)]):
            if first == end:
                continue
            at = tuple(int(c[first]) for c in columns[:3])
            listed = ",".join(map(str, columns[3][first:end].tolist()))
            if at == key:
                digest.update(("," + listed).encode())
                continue
            if key is not None:
                done.append(out())
            key, digest = at, hashlib.sha256(listed.encode())
            if len(done) == 4096:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
    if key is not None:
        done.append(out())
    if done:
        yield from pa.Table.from_batches(done).combine_chunks().to_batches()


def ends_digest(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256``: SHA-256 of the ids that end at a node, ascending, joined by commas.

    A digest is a chain, so one task must see a node's ids in their order; it streams through them and holds none.
    """
    dealt = ends.select(*KEY, "conv").repartition(*KEY).sortWithinPartitions(*KEY, "conv")
    return scan(dealt, _digested, "depth long, a long, b long, ends_sha256 string")


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """``(paths, conversations)``: each conversation c as the first h turns of c - c % group, then its own after its first h.

    h is the CRC-32 of c's decimal text modulo ``most``. Turns are ordered by turn, NULL first, ties by the SHA-256 of role and
    text; NULL roles and texts are empty ones. Rows without a conversation are left out.
    """
    own = settle(numbered(turns(conversations)), "numbered")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = F.col("conv") - F.col("conv") % group
    heads = own.where(F.col("place") < most - 1)
    known = settle(own.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).withColumn("h", h).withColumn("base", base), "known")
    taken = heads.groupBy(F.col("conv").alias("base")).agg(F.count(F.lit(1)).alias("_there"))
    shifts = settle(known.join(taken, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("_there", F.lit(0))).alias("taken")), "shifts")
    borrowed = shifts.join(heads.select(F.col("conv").alias("base"), "place", "id", "size"), "base").where("place < h")
    rest = lookup(own, shifts.select("conv", "h", "taken"), ["conv"], "inner").where("place >= h")
    paths = borrowed.select("conv", (F.col("place") + 1).alias("depth"), "id", "size").unionByName(
        rest.select("conv", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "id", "size")
    )
    return paths, shifts.select("conv")


def nodes_with_digests(paths: DataFrame, conversations: DataFrame, limit: int = ROWS) -> DataFrame:
    """``nodes`` with ``ends_sha256``; where no conversation ends, the digest of nothing."""
    nodes, ends = trie(paths, conversations, limit)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends_digest(ends), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
