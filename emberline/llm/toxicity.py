"""Toxicity as a compression distance: two zstandard dictionaries, one trained on ordinary and one on toxic text.

A window of some words is compressed twice, with the ordinary dictionary and with the ordinary plus the toxic one; the
bytes that the toxic dictionary saves are its gain. A document's gains become a probability by a logistic fit on
labelled documents that had no part in the dictionaries. Toxic text is mostly ordinary text, so the toxic
dictionary is trained on what toxic documents have more often than ordinary ones, near copies counted once.

The fit uses a bounded sample of the labelled rows (``SAMPLE`` documents of each label for the dictionaries and as
many for the calibration, in hash order, of at most ``SAMPLE_BYTES``); every document is scored, every window of it.

Edge cases: a NULL or empty text has no window and gets the score of a text without gains; labels that are NULL are left
out, a document labelled both ways counts as toxic; an id that is repeated is fitted on once; without labels of either kind all scores are 0; documents with
equal or NULL ids are scored each by its own text.
"""

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import rows, scan, ship, worker_state
from emberline.operators.lineage import settle

ship(__name__)

WINDOW, LEVEL = 11, 13
ORDINARY_BYTES, TOXIC_BYTES = 24_000, 1_536
#: Bounds of the labelled sample.
SAMPLE, SAMPLE_BYTES = 4_000, 48 << 20
#: A word is toxic evidence if it is in so many toxic documents and so much more often there than in ordinary ones.
MIN_DOCS, MIN_RATIO = 4, 20
HELD_OUT = 2

_BETWEEN = re.compile(r"[^\w]+")


def split_words(text: str | None) -> list[bytes]:
    return _BETWEEN.sub(" ", (text or "").lower()).encode("utf-8", "surrogatepass").split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def unlike(texts: list[list[bytes]], tries: int = 6, similarity: float = 0.8) -> list[int]:
    """Texts that no kept earlier one resembles: one of each group of near copies. MinHashes of word triples find, Jaccard decides."""
    kept: dict[int, np.ndarray] = {}
    seen: dict[tuple[int, int], list[int]] = {}
    for i, w in enumerate(texts):
        triples = np.unique(np.array([zlib.crc32(b" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))], np.uint64))
        own = [(j, int(((triples * np.uint64(2 * j + 1) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)).min())) for j in range(tries)]
        for k in {k for x in own for k in seen.get(x, ())}:
            both = np.isin(triples, kept[k], assume_unique=True).sum()
            if both >= similarity * (len(triples) + len(kept[k]) - both):
                break
        else:
            kept[i] = triples
            for x in own:
                seen.setdefault(x, []).append(i)
    return list(kept)


def train_dictionaries(ordinary: list[str], toxic: list[str]) -> tuple[bytes, bytes]:
    """Raw contents of the ordinary dictionary and of the ordinary with the toxic one behind it."""
    split = [[split_words(t) for t in texts] for texts in (ordinary, toxic)]
    plain, bad = ([w[i] for i in unlike(w)] for w in split)
    df = [Counter(x for w in texts for x in set(w)) for texts in (plain, bad)]
    rate = MIN_RATIO * len(bad) / max(1, len(plain))
    marked = {x for x, k in df[1].items() if k >= MIN_DOCS and k >= rate * (df[0][x] + 0.5)}
    evidence = [x for w in bad for x in windows([y for y in w if y in marked])]
    text = [x for w in plain for x in windows(w)]
    base = _train(text, ORDINARY_BYTES + TOXIC_BYTES)
    extra = _train(evidence, TOXIC_BYTES)
    return base, base[-ORDINARY_BYTES:] + extra


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's content; if there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, **bare)
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
    return zstandard.ZstdCompressor(compression_params=params, dict_data=raw)


#: What a document's gains become: the three largest, what exceeds ``SLACK`` in all, the same per window, windows (log).
FEATURES = ("top1", "top2", "top3", "excess", "density", "length")
SLACK = 3


def features(gains: list[int]) -> list[float]:
    top = sorted((g for g in gains if g > 0), reverse=True)[:3] + [0, 0, 0]
    excess = sum(g - SLACK for g in gains if g > SLACK)
    return [float(x) for x in (*top[:3], excess, excess / max(1, len(gains)), math.log1p(len(gains)))]


def gains(docs: DataFrame, dictionaries: tuple[bytes, bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the features of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    tag = f"toxicity_{zlib.crc32(dictionaries[1])}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, bad = worker_state(tag, lambda: tuple(compressor(d) for d in dictionaries))
        for b in batches:
            out = []
            for (texts,) in rows([b], "_text"):
                for t in texts:
                    own = windows(split_words(t))
                    out.append(features([len(plain.compress(x)) - len(bad.compress(x)) for x in own]))
            columns = np.array(out, np.float64).reshape(-1, len(FEATURES)).T
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], names=["doc_id", *FEATURES])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return scan(narrow, run, ", ".join([f"doc_id {kind}", *(f"{f} double" for f in FEATURES)]))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> tuple[list[float], float]:
    """Weights and intercept of a logistic regression, by Newton's method on scaled features."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / sd, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, a.T @ (p - y) + ridge * w)
    weights = w[:-1] / sd
    return weights.tolist(), float(w[-1] - mean @ weights)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)), F.lit(HELD_OUT))


def labelled_sample(labels: DataFrame, n: int) -> dict[str, list]:
    """Ids for the dictionaries (folds 0 and 1) and the calibration (fold 3), up to ``n`` of each label, in hash order."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != HELD_OUT).withColumn("_use", F.when(fold(F.col("doc_id")) == 3, "fit").otherwise("train"))
    out: dict[str, list] = {}
    for use in ("train", "fit"):
        for toxic in (0, 1):
            part = known.where((F.col("_use") == use) & (F.col("toxic") == toxic))
            found = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id").collect()
            out[f"{use}{toxic}"] = [x[0] for x in found]
    return out


def sample_texts(docs: DataFrame, ids: list, limit: int, doc_id: str = "doc_id", text: str = "text") -> list[str]:
    """Texts of the named documents (a bounded list), whole, of ``limit`` bytes at most, in hash order; a text that does not fit is skipped.

    An id that is repeated counts once, with its greatest text, so there are no more texts than ids.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], f"_id {kind}"))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(wanted, "_id", "left_semi")
    one = settle(texts.where("_text IS NOT NULL").groupBy("_id").agg(F.max("_text").alias("_text")), "toxicity-sample")
    hashed = F.xxhash64("_id", "_text").alias("_order")
    total, taken = 0, []
    for key, size, _ in one.select("_id", F.octet_length("_text"), hashed).orderBy("_order", "_id").collect():
        if total + size <= limit:
            total += size
            taken.append((key,))
    if not taken:
        return []
    chosen = one.join(F.broadcast(spark.createDataFrame(taken, f"_id {kind}")), "_id", "left_semi")
    return [x[0] for x in chosen.select("_text", hashed, "_id").orderBy("_order", "_id").collect()]


def score(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """``doc_id, score`` and the features behind it, for every document."""
    ids = labelled_sample(labels, sample)
    plain, bad = (sample_texts(docs, ids[k], sample_bytes // 2, doc_id, text) for k in ("train0", "train1"))
    found = settle(gains(docs, train_dictionaries(plain, bad), doc_id, text), "toxicity-gains")
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    held = [(i, y) for y in (0, 1) for i in ids[f"fit{y}"]]
    if not (bad and ids["fit0"] and ids["fit1"]):
        return found.withColumn("score", F.lit(0.0))
    known = F.broadcast(spark.createDataFrame(held, f"doc_id {kind}, _y int"))
    # One row a labelled id, in order: sums and the fit do not depend on how the rows are dealt.
    best = found.join(known, "doc_id").groupBy("doc_id", "_y").agg(F.max(F.struct(*FEATURES)).alias("f"))
    table = best.orderBy("doc_id").select("f.*", "_y").collect()
    x = np.array([r[:-1] for r in table], float)
    weights, intercept = fit(x, np.array([r[-1] for r in table], float))
    z = F.lit(intercept)
    for name, w, least, most in zip(FEATURES, weights, x.min(axis=0).tolist(), x.max(axis=0).tolist()):
        z = z + F.lit(w) * F.least(F.greatest(F.col(name), F.lit(least)), F.lit(most))  # no guess beyond what was seen
    return found.withColumn("score", 1 / (1 + F.exp(-z)))
