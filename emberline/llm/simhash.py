"""SimHash near-duplicates by the general pigeonhole principle.

Bits that agree with each other often go into the same part. If parts get thresholds that add up to
``distance - parts + 1``, two fingerprints within the distance meet some part's threshold. Which number of parts and
which thresholds are cheapest is found by dynamic programming over estimated candidate counts; the estimates come from how
often bits and pairs of bits are set over all fingerprints. A part with threshold t is probed with the values that
remain when t of its bits are left out. Fingerprints that share such a value are candidates and are verified.

Only distinct fingerprints are compared; copies share one. Nothing but 64 x 64 counts reaches the driver.

Edge cases: a NULL text, or one without words, has fingerprint zero and is linked like any other; rows with equal ids
are separate documents of the same group or not, by their texts; NULL ids never name a group that has another id; an
empty table gives an empty result; other columns are not read.
"""

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm import links
from emberline.llm.common import arrow_schema, carried, rows, scan, ship, taken_back
from emberline.operators.lineage import settle

ship(__name__)

BITS, SHINGLE, DISTANCE, SEED = 64, 3, 3, 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Cost of a candidate pair against that of a probed value.
PAIR_COST = 1.0


def fingerprint(text: str | None) -> bytes:
    """Eight bytes, the highest bit first."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return bytes(8)
    if len(w) < SHINGLE:
        shingles = [b" ".join(w)]
    else:
        shingles = [b" ".join(x) for x in zip(*(w[i:] for i in range(SHINGLE)))]
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(shingles), 1 << 16):
        raw = b"".join([digest(s, SEED) for s in shingles[start : start + (1 << 16)]])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_fp``, the fingerprint as a long."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "_fp long"])
    out, names = arrow_schema(schema), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join(fingerprint(t) for (part,) in rows([b], text) for t in part)
            own = [b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], schema=out)

    return scan(docs, run, schema)


def bit_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for every pair of bits how many have both set (64 x 64, from all of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        at = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at), "n": pa.array(np.append(both.ravel(), n).astype(np.int64))})

    sums = scan(classes.select("_fp"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for at, n in sums:
        flat[at] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def agreement(n: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For two random fingerprints: chance that bit i agrees; that i and j agree; that neither does."""
    one = both.diagonal() / n
    p11 = both / n
    p10, p01 = one[:, None] - p11, one[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    return one**2 + (1 - one) ** 2, p11**2 + p10**2 + p01**2 + p00**2, 2 * (p11 * p00 + p10 * p01)


def grouped_bits(both_agree: np.ndarray, agree: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal size; each takes the bit that depends most on the one it took last."""
    tie = np.abs(both_agree - np.outer(agree, agree))
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        last = max(free, key=lambda i: (max((tie[i, j] for j in free if j != i), default=0), -i))
        part = [last]
        free.discard(last)
        while len(part) < size:
            last = max(free, key=lambda i: (tie[last, i], -i))
            part.append(last)
            free.discard(last)
        out.append(part)
    return out


def within(part: list[int], most: int, agree: np.ndarray, both_agree: np.ndarray, neither: np.ndarray) -> list[float]:
    """Chance that two random fingerprints differ in at most 0, 1, ... ``most`` bits of a part, bit by bit along it."""
    same, differ = np.zeros(most + 2), np.zeros(most + 2)  # by the number of differing bits; the last holds all above
    same[0], differ[1] = agree[part[0]], 1 - agree[part[0]]
    for i, j in zip(part, part[1:]):
        ss = both_agree[i, j] / max(agree[i], 1e-12)
        dd = neither[i, j] / max(1 - agree[i], 1e-12)
        up = lambda x: np.append([0.0], x[:-1])
        same, differ = same * ss + differ * (1 - dd), up(same * (1 - ss) + differ * dd)
    return np.cumsum(same + differ)[: most + 1].tolist()


def plan(n: int, both: np.ndarray, distance: int = DISTANCE, max_parts: int = 6) -> list[tuple[list[int], int]]:
    """Parts with their thresholds (those with threshold -1 left out), cheapest by the estimates."""
    stats = agreement(max(n, 1), both) if n else (np.full(BITS, 0.5), np.full((BITS, BITS), 0.25), np.full((BITS, BITS), 0.25))
    agree, both_agree, neither = stats
    best: tuple[float, list] = (math.inf, [])
    for parts in range(1, max_parts + 1):
        total = distance - parts + 1
        groups = grouped_bits(both_agree, agree, parts)
        # cheapest cost of the first parts for each sum of thresholds
        costs: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            close = within(bits, distance, agree, both_agree, neither)
            price = {-1: 0.0} | {
                t: n * math.comb(len(bits), t) + PAIR_COST * n * n / 2 * close[t] * math.comb(len(bits), t) / (1 + t * len(bits))
                for t in range(distance + 1)
            }
            step: dict[int, tuple[float, list[int]]] = {}
            for (s, (c, ts)), (t, p) in itertools.product(costs.items(), price.items()):
                if s + t not in step or c + p < step[s + t][0]:
                    step[s + t] = c + p, [*ts, t]
            costs = step
        if total in costs and costs[total][0] < best[0]:
            best = costs[total][0], list(zip(groups, costs[total][1]))
    return [(bits, t) for bits, t in best[1] if t >= 0]


def masks(parts: list[tuple[list[int], int]]) -> np.ndarray:
    """The bits that are looked at in each probe; bit 0 is the highest."""
    out = []
    for bits, t in parts:
        for left_out in itertools.combinations(bits, t):
            out.append(sum(1 << (BITS - 1 - b) for b in bits if b not in left_out))
    return np.array(out, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def probes(classes: DataFrame, looks: np.ndarray) -> DataFrame:
    """``key, node, value``: the masked values of every fingerprint."""
    salt = _mix(np.arange(1, len(looks) + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for start in range(0, len(fp), 4096):
                own = fp[start : start + 4096]
                key = _mix((own.view(np.uint64)[:, None] & looks) ^ salt)
                node = pa.array(np.repeat(own, len(looks)))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), node, node], names=["key", "node", "value"])

    return scan(classes.select("_fp"), run, "key long, node long, value long")


def _near(distance: int) -> links.Linked:
    def linked(values: pa.Array, some: np.ndarray, others: np.ndarray) -> np.ndarray:
        fp = values.to_numpy().view(np.uint64)
        return np.bitwise_count(fp[some][:, None] ^ fp[others]) <= distance

    return linked


def groups(fps: DataFrame, doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """``_fp, component_id`` and the member that stands for the group (``rep_fp``, its id is ``component_id``).

    ``fps`` has an id and ``_fp`` per document and should be settled.
    """
    classes = settle(fps.groupBy("_fp").agg(F.min(doc_id).alias("_id")), "simhash-classes")
    parts = plan(*bit_counts(classes), distance)
    found = links.links(probes(classes, masks(parts)), _near(distance))
    rooted = classes.join(links.roots(fps.sparkSession, found).select(F.col("node").alias("_fp"), "root"), "_fp", "left")
    rooted = settle(rooted.select("_fp", "_id", F.coalesce("root", "_fp").alias("root")), "simhash-rooted")
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id").alias("id"), F.col("_fp").alias("fp"))).alias("_first")
    named = rooted.groupBy("root").agg(first)
    return rooted.join(named, "root").select("_fp", F.col("_first.id").alias("component_id"), F.col("_first.fp").alias("rep_fp"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    fps = settle(fingerprints(narrow, "_text").select("doc_id", "_fp"), "simhash")
    return fps.join(groups(fps, "doc_id", distance), "_fp").select("doc_id", hex_digits(F.col("_fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One document of each group, the one with the smallest id, with the columns of ``docs``."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    fps = settle(fingerprints(narrow, "_text").select("doc_id", "_fp"), "simhash")
    stay = groups(fps, "doc_id", distance).where("_fp = rep_fp").select("_fp", F.col("component_id").alias("_id"))
    again = fingerprints(docs.select(F.col(doc_id).alias("_doc"), carried(docs, text), F.col(text).alias("_text")), "_text")
    kept = again.join(stay, (again["_fp"] == stay["_fp"]) & again["_doc"].eqNullSafe(stay["_id"]), "left_semi")
    back = taken_back(docs, text) | {text: F.col("_text")}
    own = [back[c].alias(c) for c in docs.columns]
    return kept.dropDuplicates(["_fp", "_doc"]).select(*own)
