"""Exact removal of repeated byte strings by bucket-pointer refinement, distributed.

A full suffix array of the corpus would hold a row per byte. Instead, every string of ``length`` bytes is represented by its
anchor, the q-gram with the smallest hash in it (the leftmost of equal ones): equal strings have equal anchors at equal offsets. Anchors
start in the bucket of their q-gram. Strings of an anchor are told apart by the offset of the anchor in them; for a
range of offsets all of them share a core and lie in an outer string.

* Anchors with equal outer strings repeat each other: all strings of that range are repeats, no finer look is needed.
* An anchor alone in its bucket has no repeat.
* The rest is refined: the range of offsets is halved, the core grows, and the bucket splits by the identifier of the
  longer core. That is done recursively; a range of one offset is one string, so its bucket decides.

Buckets are counted with partial sums before the shuffle and only one representative of equal outer strings is refined.
A bucket is refined by one task; one of more than ``GROUP`` representatives is first split, in the cluster, by the cores of
the halves. No step compares pairs.

Edge cases: a NULL or short text has nothing to remove; rows with equal ids and texts repeat each other; a repeat within one
text counts, overlapping or not; rows are known by hashes of their text and id, so NULL ids do no harm.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import arrow_schema, key_filter, passes, rows, scan, ship
from emberline.operators.lineage import settle

ship(__name__)

LENGTH, Q = 200, 32
#: Positions looked at together in one text, a power of two.
CHUNK_BITS = 19
#: Anchors of a bucket that one task refines; larger buckets are first split by longer cores, in the cluster.
GROUP = 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def qgram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``Q`` bytes (a power of two) from each position, by doubling."""
    h, width = _mix(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while width < Q:
        h = h[:-width] * np.uint64(0x9FB21C651E98DF25 + 2 * width) + h[width:]
        width *= 2
    return _mix(h)


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor, first and last start of its strings, and bucket, for every anchor of a text of ``length`` bytes or more."""
    n_starts = len(data) - length + 1
    if n_starts < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    chunk = 1 << CHUNK_BITS
    mask = np.uint64(2 * chunk - 1)
    width = length - Q + 1
    at, found = [], []
    for first in range(0, n_starts, chunk):
        h = qgram_hashes(data[first : min(first + chunk + length - 1, len(data))])
        low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(h) - width + 1], low[width - span : len(h) - span + 1])
        place = (low & mask).astype(np.int64)
        at.append(place + first)
        found.append(h[place])
    at, found = np.concatenate(at), np.concatenate(found)
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.concatenate([lo[1:], [n_starts]]) - 1
    return at[lo], lo, hi, found[lo]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, bytes]]:
    with np.errstate(over="ignore"):
        for r1, r2, texts in rows(batches, "r1", "r2", "_text"):
            for a, b, t in zip(r1, r2, texts):
                data = (t or "").encode("utf-8", "surrogatepass")
                yield a, b, np.frombuffer(data, np.uint8), data


def _packed(made: Iterator[dict], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Column parts joined to batches of some thousand rows."""
    held: list[dict] = []
    n = 0
    for part in made:
        held.append(part)
        n += len(next(iter(part.values())))
        if n >= size:
            yield _joined(held)
            held, n = [], 0
    if n:
        yield _joined(held)


def _joined(parts: list[dict]) -> pa.RecordBatch:
    join = lambda k: pa.array([x for p in parts for x in p[k]], pa.binary()) if isinstance(parts[0][k], list) else pa.array(np.concatenate([p[k] for p in parts]))
    return pa.RecordBatch.from_pydict({k: join(k) for k in parts[0]})


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``r1, r2`` (what a row is known by), its id and text."""
    t = F.coalesce(F.col(text), F.lit(""))
    r1, r2 = F.xxhash64(t), F.xxhash64(F.col(doc_id), F.octet_length(t), F.lit("id"))
    return docs.select(r1.alias("r1"), r2.alias("r2"), F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))


ANCHOR = "r1 long, r2 long, at long, near int, far int, bucket long, outer long"


def _anchors(named: DataFrame, length: int, buckets: np.ndarray | None = None) -> DataFrame:
    """An anchor per row: bucket of its q-gram, class of its outer string, and its range of offsets ``near`` to ``far``.

    With a filter only anchors of the buckets that pass.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        digest = xxhash.xxh64_intdigest
        for r1, r2, data, raw in _texts(batches):
            at, lo, hi, bucket = anchors(data, length)
            if buckets is not None and len(at):
                own = passes(buckets, bucket)
                at, lo, hi, bucket = at[own], lo[own], hi[own], bucket[own]
            if len(at):
                outer = [digest(raw[i : j + length], k) for i, j, k in zip(lo.tolist(), hi.tolist(), (at - lo).tolist())]
                yield {
                    "r1": np.full(len(at), r1, np.int64), "r2": np.full(len(at), r2, np.int64), "at": at,
                    "near": (at - hi).astype(np.int32), "far": (at - lo).astype(np.int32),
                    "bucket": bucket.view(np.int64), "outer": np.array(outer, np.uint64).view(np.int64),
                }

    return scan(named.select("r1", "r2", "_text"), lambda b: _packed(made(b)), ANCHOR)


def _contexts(named: DataFrame, wanted: np.ndarray, length: int) -> DataFrame:
    """Anchors that pass the filter (by ``r1 XOR at``) with their outer strings."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for r1, r2, data, raw in _texts(batches):
            at, lo, hi, _ = anchors(data, length)
            own = np.flatnonzero(passes(wanted, at ^ np.int64(r1))) if len(at) else []
            if len(own):
                at, lo, hi = at[own], lo[own], hi[own]
                yield {
                    "r1": np.full(len(own), r1, np.int64), "r2": np.full(len(own), r2, np.int64), "at": at,
                    "outer_bytes": [raw[i : j + length] for i, j in zip(lo.tolist(), hi.tolist())],
                }

    return scan(named.select("r1", "r2", "_text"), lambda b: _packed(made(b), 4_000), "r1 long, r2 long, at long, outer_bytes binary")


#: An anchor in a bucket to refine: range of offsets, own offsets, and the outer string, which starts ``left`` before the anchor.
Member = tuple[int, int, int, int, bytes]


def refine(members: list[Member], length: int, first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """(member, near, far) of the repeated strings among anchors of one bucket, for the offsets ``first`` to ``last``.

    Members with equal outer strings are settled; one of each kind goes on into the two halves of the range, by their cores there.
    """
    todo = [(first, last, list(range(len(members))))]
    while todo:
        first, last, own = todo.pop()
        classes: dict[tuple, list[int]] = {}
        for m in own:
            _, left, lo, hi, data = members[m]
            lo, hi = max(lo, first), min(hi, last)
            classes.setdefault((lo, hi, data[left - hi : left - lo + length]), []).append(m)
        for (lo, hi, _), same in classes.items():
            if len(same) > 1:
                yield from ((m, lo, hi) for m in same)
        if len(classes) == 1 or first == last or all(len(same) > 1 for same in classes.values()):
            continue
        half = (first + last) // 2
        for a, b in ((first, half), (half + 1, last)):
            buckets: dict[bytes, list[int]] = {}
            for m, *_ in classes.values():
                _, left, lo, hi, data = members[m]
                if lo <= b and hi >= a:
                    buckets.setdefault(data[left - a : left - b + length], []).append(m)
            todo += [(a, b, x) for x in buckets.values() if len(x) > 1]


OPEN = "key long, o1 int, o2 int, r1 long, r2 long, at long, left int, near int, far int, outer_bytes binary"
SPAN = "s1 long, s2 long, start long, end long"


def _refined(level: DataFrame, length: int, limit: int) -> DataFrame:
    """Spans of buckets of up to ``limit`` anchors, refined by one task each; the anchors of larger ones as they are.

    Where the range is one offset, a bucket's strings are all equal and nothing is left to refine.
    """
    names = [x.split()[0] for x in OPEN.split(", ")]
    out = arrow_schema(f"{SPAN}, {OPEN}")

    def batch(spans: list, rest: list) -> pa.RecordBatch:
        table = [(*x, *[None] * len(names)) for x in spans] + [(None, None, None, None, *x) for x in rest]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*table), out)], schema=out)

    def span(row: tuple, near: int, far: int) -> tuple:
        return row[3], row[4], row[5] - far, row[5] - near + length

    def settled(group: list) -> list:
        if len(group) < 2:
            return []
        members = [(r[5], r[6], r[7], r[8], r[9]) for r in group]
        return [span(group[m], near, far) for m, near, far in refine(members, length, group[0][1], group[0][2])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, large = None, [], False
        spans: list = []
        rest: list = []
        for columns in rows(batches, *names, size=4096):
            for row in zip(*columns):
                if row[0] != key:
                    spans += settled(group)
                    key, group, large = row[0], [], False
                group.append(row)
                if large or len(group) > limit:
                    large = True
                    if row[1] == row[2]:
                        spans += [span(r, r[7], r[8]) for r in group]
                    else:
                        rest += group
                    group = []
            if len(spans) + len(rest) > 4096:
                yield batch(spans, rest)
                spans, rest = [], []
        spans += settled(group)
        if spans or rest:
            yield batch(spans, rest)

    return scan(level.select(*names).repartition("key").sortWithinPartitions("key"), run, f"{SPAN}, {OPEN}")


def _halved(large: DataFrame, length: int) -> DataFrame:
    """Anchors of large buckets in the buckets of the cores of both halves of their range."""
    half = F.floor((F.col("o1") + F.col("o2")) / 2).cast("int")
    halves = F.array(F.struct(F.col("o1"), half.alias("o2")), F.struct((half + 1).alias("o1"), F.col("o2")))
    split = large.withColumn("_half", F.explode(halves)).withColumns({"o1": F.col("_half.o1"), "o2": F.col("_half.o2")})
    split = split.where("o1 <= far AND o2 >= near").withColumns({"near": F.greatest("near", "o1"), "far": F.least("far", "o2")})
    core = F.substring("outer_bytes", F.col("left") - F.col("o1") + 1, F.col("o1") - F.col("o2") + length)
    return split.withColumn("key", F.xxhash64("key", "o1", "o2", core)).drop("_half")


def repeats(named: DataFrame, length: int = LENGTH, limit: int = GROUP) -> DataFrame:
    """``r1, r2, start, end``: spans of bytes whose strings of ``length`` bytes all start somewhere else too. They may overlap."""
    by_bucket = _anchors(named, length).groupBy("bucket")
    seen = by_bucket.agg(F.count(F.lit(1)).alias("n"), F.min("outer").alias("_a"), F.max("outer").alias("_b")).where("n > 1")
    seen = settle(seen.select("bucket", (F.col("_a") == F.col("_b")).alias("equal")), "suffix-buckets")
    span = ["r1", "r2", (F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + length).alias("end")]
    # buckets whose outer strings are all equal
    equal, mixed = seen.where("equal").select("bucket"), seen.where("NOT equal").select("bucket")
    spans = [settle(_anchors(named, length, key_filter(equal, "bucket")).join(equal, "bucket", "left_semi").select(*span), "suffix-spans")]
    if mixed.isEmpty():
        return spans[0]
    # the others: count equal outer strings, then refine one of each kind
    open_ = settle(_anchors(named, length, key_filter(mixed, "bucket")).join(mixed, "bucket", "left_semi"), "suffix-open")
    rep = F.min(F.struct("r1", "r2", "at", "near", "far")).alias("rep")
    classes = settle(open_.groupBy("bucket", "outer").agg(F.count(F.lit(1)).alias("n"), rep), "suffix-classes")
    twice = classes.where("n > 1").select("bucket", "outer")
    spans.append(settle(open_.join(twice, ["bucket", "outer"], "left_semi").select(*span), "suffix-spans"))
    alone = classes.groupBy("bucket").agg(F.min("n").alias("_least")).where("_least = 1").select("bucket")
    reps = settle(classes.join(alone, "bucket", "left_semi").select("bucket", "rep.*"), "suffix-representatives")
    wanted = key_filter(reps.select(F.col("r1").bitwiseXOR(F.col("at")).alias("key")), "key")
    level = reps.join(_contexts(named, wanted, length), ["r1", "r2", "at"]).select(
        F.col("bucket").alias("key"), F.lit(0).alias("o1"), F.lit(length - Q).alias("o2"),
        "r1", "r2", "at", F.col("far").alias("left"), "near", "far", "outer_bytes",
    )
    while True:
        found = settle(_refined(level, length, limit), "suffix-refined")
        spans.append(found.where("s1 IS NOT NULL").select(F.col("s1").alias("r1"), F.col("s2").alias("r2"), "start", "end"))
        large = found.where("key IS NOT NULL").select("key", "o1", "o2", "r1", "r2", "at", "left", "near", "far", "outer_bytes")
        if large.isEmpty():
            return reduce(DataFrame.union, spans)
        level = _halved(large, length)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


CUT = "n_bytes long, n_removed long, n_spans long, kept binary"


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and the ``kept`` bytes of every document."""
    named = keyed(docs, doc_id, text)
    kind = docs.schema[doc_id].dataType.simpleString()
    found = repeats(named, length).groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts, spans in rows([b], "doc_id", "_text", "spans", size=256):
                out = []
                for i, t, s in zip(ids, texts, spans):
                    data = (t or "").encode("utf-8", "surrogatepass")
                    gone = merged([(x["start"], x["end"]) for x in s or ()])
                    kept = b"".join(data[p:q] for p, q in zip([0, *(e for _, e in gone)], [*(a for a, _ in gone), len(data)]))
                    out.append((i, len(data), len(data) - len(kept), len(gone), kept))
                yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept"), map(list, zip(*out)))))

    joined = named.join(found, ["r1", "r2"], "left").select("doc_id", "_text", "spans")
    return scan(joined, run, f"doc_id {kind}, {CUT}")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
