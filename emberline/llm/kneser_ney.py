"""Quality by perplexity: an interpolated modified Kneser-Ney word model of trusted text.

Texts become words (lower case; digits, punctuation and code points of scripts without spaces stand alone). The word
pairs of all trusted documents (quality label 1, but for one fold that is held out) are counted by language in one
table that grows with the trusted text, and the model is written as gains: with

    log p(b | a) = log p1(b) + log rest(a) + gain(a, b)

``gain`` is zero for a pair that was never seen, so the log-probability of a document is a sum over its words, whose two
numbers come from a vocabulary of at most ``VOCABULARY`` words, plus the gains of its pairs, which are joined: the
distinct pairs of all documents are dealt by pair, meet the table of gains, and are added up by document. At most
``FREQUENT`` pairs, the most frequent ones, are looked up in place instead, so a very common pair is never dealt, and a
filter of fixed size holds back pairs that are in no trusted text. Pairs are dealt as columns of numbers, sorted and
compressed, a row for each bucket of what a task has gathered from some ``FLUSH`` words; a pair has one entry a document
there, so no bucket outgrows the others by a common pair. A document is rejected above the quantile of the held-out
trusted documents of its language and length class.

Strata come from the language column: a value with ``MIN_TRUSTED`` trusted documents or more is a stratum of its own (the 255 largest),
all others and NULL share one. Words outside the vocabulary are one class, whose probability is spread evenly over the different words
that training text has in it, and one more.

Edge cases: a NULL text, or one without words, has no perplexity and is not kept; a stratum without training text has no
model: no perplexity, nothing rejected; a class with fewer than ``MIN_HELD`` held-out documents takes the quantile of its
language, a language with fewer that of all, and fewer in all reject nothing; labels that are NULL, or repeated and not
all good, are no trust; equal or NULL ids are scored each by its text; other columns play no part.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import arrow_schema, key_filter, passes, quoted, rows, scan, ship
from emberline.operators.lineage import settle
from emberline.operators.quantiles import quantiles

ship(__name__)

#: Bounds of what goes to all tasks: words with two numbers each, pairs with one.
VOCABULARY, FREQUENT = 1 << 18, 1 << 20
STRATA, MIN_TRUSTED = 255, 50
QUANTILE, MIN_HELD = 0.995, 50
#: Upper ends of the length classes, in characters.
LENGTHS = (60, 120, 250, 500, 1000, 4000)
HELD_OUT, FOLDS = 1, 4
#: Up to so many trusted ids go to all tasks (8 bytes each, or short strings); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: A pair of words is one number: the first word's above this many bits of the second's.
BITS = 20
#: So many words are counted before a task hands on what it has; with pairs, so many texts at most, numbered in ``TEXT_BITS`` bits.
FLUSH, TEXT_BITS = 1 << 20, 16
#: Pairs are dealt to so many buckets: when they are counted, and when they are asked for; there more if a bucket would have more pairs.
COUNT_BUCKETS, ASK_BUCKETS, BUCKET_PAIRS = 256, 32, 1 << 23

#: Kana, ideographs, Thai, Lao and Khmer have no spaces between words: a code point is a word there.
_NO_SPACES = "฀-໿ក-៿぀-ヿ㐀-鿿豈-﫿"
_WORD = re.compile(rf"[{_NO_SPACES}]|[^\W\d_{_NO_SPACES}]+|\d|[^\w\s]|_")


def split_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Keys(dict):
    """64-bit keys of the words of one stratum; forgets all when it gets large."""

    def __init__(self, stratum: int):
        self.stratum = stratum

    def __missing__(self, word: str) -> int:
        if len(self) > FLUSH:
            self.clear()
        key = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), self.stratum)
        self[word] = key
        return key


class Texts:
    """Texts to arrays of word keys; one for each task."""

    def __init__(self) -> None:
        self.known: dict[int, _Keys] = {}

    def keys(self, stratum: int, text: str | None) -> np.ndarray:
        known = self.known.setdefault(stratum, _Keys(stratum))
        return np.array([known[w] for w in split_words(text)], np.uint64).view(np.int64)


@dataclass
class Vocabulary:
    """Words by key. Numbers: the words outside it of each stratum, the starts of texts of each stratum, then the words."""

    strata: int
    keys: np.ndarray  # sorted
    stratum: np.ndarray

    def __len__(self) -> int:
        return 2 * self.strata + len(self.keys)

    def numbers(self, stratum: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return stratum
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, 2 * self.strata + at, stratum)

    def pairs(self, strata: list[int], texts: list[np.ndarray]) -> np.ndarray:
        """Each word of some texts, none of them empty, with the one before it as a pair."""
        if not texts:
            return np.zeros(0, np.int64)
        stratum, sizes = np.array(strata, np.int64), np.array([*map(len, texts)])
        words = self.numbers(np.repeat(stratum, sizes), np.concatenate(texts))
        before = np.concatenate([[0], words[:-1]])
        before[np.cumsum(sizes) - sizes] = self.strata + stratum
        return before << BITS | words

    def strata_of(self) -> np.ndarray:
        each = np.arange(self.strata)
        return np.concatenate([each, each, self.stratum])


def fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(FOLDS))


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    return good.where("_good = 1").select(F.col("doc_id").alias("_id"))


def of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of ``docs`` with one of ``n`` ids; only what a filter lets through is dealt if these are many."""
    if n <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), "_id", "left_semi")
    words = key_filter(ids.select(F.xxhash64("_id").alias("key")), "key")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(b.schema.get_field_index("_key")).to_numpy()
            yield b.filter(pa.array(passes(words, key))).select([f for f in b.schema.names if f != "_key"])

    return scan(docs.withColumn("_key", F.xxhash64("_id")), some, schema).join(ids, "_id", "left_semi")


def stratum(lang: Column, names: list[str]) -> Column:
    """1, 2, ... for the languages named, 0 for others and NULL."""
    if not names:
        return F.lit(0)
    return F.coalesce(F.array_position(F.array(*map(F.lit, names)), lang), F.lit(0)).cast("int")


def _heaviness(c: str) -> Column:
    return F.floor(F.log2(F.col(c)) * 8).cast("int")


def heavy(df: DataFrame, c: str, limit: int) -> Column:
    """Whether a row is among those with the greatest counts, ``limit`` at most: a histogram of a few hundred steps, a step in whole or not at all."""
    left, least = limit, None
    for step, n in sorted(map(tuple, df.groupBy(_heaviness(c).alias("s")).count().collect()), reverse=True):
        left -= n
        if left < 0:
            break
        least = step
    return F.lit(False) if least is None else _heaviness(c) >= least


def _mixed(pairs: np.ndarray) -> np.ndarray:
    x = pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _buckets(pairs: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets, of ``n``, that ``pairs`` fall into, and the places in each, ascending."""
    bucket = ((_mixed(pairs).view(np.uint64) >> np.uint64(24)) % np.uint64(n)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for start, end in zip(edges, [*edges[1:], len(order)]):
        yield int(bucket[order[start]]), order[start:end]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 up, as few bytes each as the largest needs: first bytes first, compressed."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    planes = numbers.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[1:], decompressed_size=data[0] * n, codec="zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, : data[0]] = planes.reshape(data[0], n).T
    return out.view("<i8")[:, 0].astype(np.int64)


def packed_pairs(pairs: np.ndarray) -> bytes:
    """Ascending pairs."""
    return packed(np.diff(pairs, prepend=0))


def unpacked_pairs(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n))


def _summed(pairs: list[np.ndarray], c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, ascending, with the sums of their counts."""
    pair, n = np.concatenate(pairs), np.concatenate(c)
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    edges = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[edges], np.add.reduceat(n[order], edges) if len(edges) else n


def word_counts(texts: DataFrame) -> DataFrame:
    """``_lang, word, c`` over all of ``texts`` (``_lang, _text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Texts()
        waiting: dict[int, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, arrays in waiting.items():
                word, n = np.unique(np.concatenate(arrays), return_counts=True)
                yield pa.RecordBatch.from_pydict({"_lang": pa.array(np.full(len(word), lang, np.int32)), "word": pa.array(word), "c": pa.array(n)})

        for langs, texts in rows(batches, "_lang", "_text", size=64):
            for lang, t in zip(langs, texts):
                found = read.keys(lang, t)
                waiting.setdefault(lang, []).append(found)
                size += len(found)
                if size >= FLUSH:
                    yield from out()
                    waiting, size = {}, 0
        yield from out()

    found = scan(texts.select("_lang", "_text"), run, "_lang int, word long, c long")
    return settle(found.groupBy("_lang", "word").agg(F.sum("c").alias("c")), "kneser-ney-words")


def pair_counts(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``pair, c`` over all of ``texts``."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(COUNT_BUCKETS, tasks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, langs, waiting, size = Texts(), [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            pair, c = np.unique(vocabulary.pairs(langs, waiting), return_counts=True)
            parts = list(_buckets(pair, buckets))
            columns = {
                "bucket": pa.array([b for b, _ in parts], pa.int32()),
                "size": pa.array([len(at) for _, at in parts], pa.int32()),
                "pairs": pa.array([packed_pairs(pair[at]) for _, at in parts], pa.binary()),
                "counts": pa.array([packed(c[at]) for _, at in parts], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns)

        for some, texts in rows(batches, "_lang", "_text", size=64):
            for lang, t in zip(some, texts):
                keys = read.keys(lang, t)
                if len(keys):
                    langs.append(lang)
                    waiting.append(keys)
                    size += len(keys)
                if size >= FLUSH:
                    yield from out()
                    langs, waiting, size = [], [], 0
        yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, size, least = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, FLUSH
        for sizes, some, c in rows(batches, "size", "pairs", "counts"):
            for n, p, x in zip(sizes, some, c):
                pairs.append(unpacked_pairs(p, n))
                counts.append(unpacked(x, n))
                size += n
                if size >= least:
                    pair, total = _summed(pairs, counts)
                    pairs, counts, size = [pair], [total], len(pair)
                    least = max(FLUSH, 2 * size)
        pair, total = _summed(pairs, counts)
        for start in range(0, len(pair), FLUSH):
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pair[start : start + FLUSH]), "c": pa.array(total[start : start + FLUSH])})

    found = scan(texts.select("_lang", "_text"), count, "bucket int, size int, pairs binary, counts binary")
    return settle(scan(found.repartition(tasks, "bucket"), add, "pair long, c long"), "kneser-ney-pairs")


def discounts(n: np.ndarray) -> np.ndarray:
    """The discounts of what occurs never, once, twice, and more often, by stratum; ``n`` has how many occur 1 to 4 times."""
    out = np.zeros((len(n), 4))
    for s, (n1, n2, n3, n4) in enumerate(n.astype(float)):
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
            raw = k - (k + 1) * y * b / a if a and n1 and n2 else 0.5 * min(k, 2)
            out[s, k] = min(max(raw, 0.05), k - 0.05)
    return out


@dataclass
class Model:
    """What the vocabulary bounds: two numbers a word, and those that pairs become gains with."""

    vocabulary: Vocabulary
    single: np.ndarray  # log2 p1, of a class of unknown words for each of them
    rest: np.ndarray  # log2 of what a word leaves to p1
    total: np.ndarray
    p1: np.ndarray
    discount: np.ndarray  # by stratum
    trained: np.ndarray  # by stratum

    def gains(self, pairs: np.ndarray, c: np.ndarray) -> np.ndarray:
        a, b = pairs >> BITS, pairs & ((1 << BITS) - 1)
        share = (c - self.discount[self.vocabulary.strata_of()[a], np.minimum(c, 3)]) / self.total[a]
        return np.log2(1 + share / (2 ** self.rest[a] * self.p1[b]))


def model(words: DataFrame, pairs: DataFrame, vocabulary: Vocabulary) -> Model:
    """Discounts, back-off weights and single-word probabilities, from sums by word: as many rows as the vocabulary."""
    size, n_strata, strata = len(vocabulary), vocabulary.strata, vocabulary.strata_of()
    first, second = F.shiftright("pair", BITS).alias("word"), F.col("pair").bitwiseAND((1 << BITS) - 1).alias("word")
    exact = [F.count(F.when(F.col("c") == k, 1)).alias(f"m{k}") for k in (1, 2, 3, 4)]
    followed = np.zeros((size, 6), np.int64)  # total, once to four times, any
    for b in pairs.groupBy(first).agg(F.sum("c").alias("total"), *exact, F.count(F.lit(1)).alias("m")).toArrow().to_batches():
        at = b.column(0).to_numpy()
        for i in range(6):
            followed[at, i] = b.column(i + 1).to_numpy()
    types = np.zeros(size, np.int64)
    for b in pairs.groupBy(second).agg(F.count(F.lit(1)).alias("m")).toArrow().to_batches():
        types[b.column(0).to_numpy()] = b.column(1).to_numpy()
    outside = np.zeros(n_strata)  # different words of training text that are not in the vocabulary
    for r in words.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect():
        outside[r[0]] = r[1]
    inside = np.bincount(vocabulary.stratum, minlength=n_strata)
    outside -= inside

    by_stratum = lambda values: np.bincount(strata, values, minlength=n_strata)
    single_d = discounts(np.stack([by_stratum(types == k) for k in (1, 2, 3, 4)], axis=1))
    less = single_d[strata, np.minimum(types, 3)]
    all_types = by_stratum(types)
    trained = all_types > 0
    every = np.maximum(all_types, 1)
    left = np.where(trained, by_stratum(less) / every, 1.0)
    p1 = np.maximum(types - less, 0) / every[strata] + (left / (inside + 1))[strata]
    single = np.log2(p1)
    single[:n_strata] -= np.log2(outside + 1)

    discount = discounts(np.stack([by_stratum(followed[:, k]) for k in (1, 2, 3, 4)], axis=1))
    more = followed[:, 5] - followed[:, 1] - followed[:, 2]
    mass = discount[strata, 1] * followed[:, 1] + discount[strata, 2] * followed[:, 2] + discount[strata, 3] * more
    total = np.maximum(followed[:, 0], 1)
    rest = np.log2(np.where(followed[:, 0] > 0, mass / total, 1.0))
    return Model(vocabulary, single, rest, total, p1, discount, trained)


def gain_table(pairs: DataFrame, fitted: Model) -> DataFrame:
    """``pair, c, gain, mixed`` of every pair; worked out from the counts wherever it is read, never written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            columns = {"pair": pair, "c": c, "gain": fitted.gains(pair, c), "mixed": _mixed(pair)}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    return scan(pairs.select("pair", "c"), run, "pair long, c long, gain double, mixed long")


#: What is dealt. To a bucket: a row of the table (``batch`` -1: ``size`` pairs with their counts), or of what a batch of ``n`` texts asks for (pairs, each
#: with the text's number in the batch and how often it is there). Rows that have no pairs hold the batch's texts, as arrays, and pass by the table.
_ASKED = "bucket int, batch long, n int, size int, pairs binary, times binary, texts binary"
_KEPT = ["ids", "langs", "chars", "n_words", "likes", "bits"]


def _kept(kind: str) -> str:
    return f"ids array<{kind}>, langs array<int>, chars array<long>, n_words array<long>, likes array<int>, bits array<double>"


def _dealt_table(pairs: DataFrame, buckets: int, kind: str) -> DataFrame:
    schema = f"{_ASKED}, {_kept(kind)}"
    whole = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            pair, c = _summed([x for x, _ in waiting], [x for _, x in waiting])
            yield _rows_of(whole, -1, 0, [(b, pair[at], c[at], None) for b, at in _buckets(pair, buckets)])

        for b in batches:
            waiting.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= FLUSH:
                yield from out()
                waiting, size = [], 0
        if waiting:
            yield from out()

    return scan(pairs.select("pair", "c"), run, schema)


def _rows_of(schema: pa.Schema, batch: int, n: int, parts: list[tuple], kept: dict[str, pa.Array] | None = None, place: int = 0) -> pa.RecordBatch:
    """A row for each of ``parts`` (bucket, pairs, how often, texts or None), and one at bucket ``place`` for the texts kept, if any."""
    more = 0 if kept is None else 1
    some = {
        "bucket": [b for b, *_ in parts] + [place] * more,
        "batch": [batch] * (len(parts) + more),
        "n": [n] * (len(parts) + more),
        "size": [len(p) for _, p, *_ in parts] + [0] * more,
        "pairs": [packed_pairs(p) for _, p, *_ in parts] + [None] * more,
        "times": [packed(t) for _, _, t, _ in parts] + [None] * more,
        "texts": [None if x is None else packed(x) for *_, x in parts] + [None] * more,
    }
    columns = []
    for f in schema:
        if f.name in some:
            columns.append(pa.array(some[f.name], f.type))
        elif kept is None:
            columns.append(pa.nulls(len(parts), f.type))
        else:
            columns.append(pa.concat_arrays([pa.nulls(len(parts), f.type), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), kept[f.name]).cast(f.type)]))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def log_probabilities(docs: DataFrame, fitted: Model, pairs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``_id, _lang, chars, n_words, bits`` of every document of ``docs`` (``_id, _lang, _text``); no bits without words or model.

    A batch of texts, as a task reads them, asks once for those that are equal; ``docs`` has to come in the same order if a task is run again.
    """
    kind = docs.schema["_id"].dataType.simpleString()
    often = heavy(pairs, "c", frequent)
    top = gain_table(pairs.where(often), fitted).select("pair", "gain").toArrow()
    order = np.argsort(top.column(0).to_numpy())
    known, known_gain = top.column(0).to_numpy()[order], top.column(1).to_numpy()[order].astype(np.float32)
    others = pairs.where(~often)
    buckets = max(ASK_BUCKETS, -(-others.count() // BUCKET_PAIRS))
    words, vocabulary = key_filter(gain_table(others, fitted), "mixed"), fitted.vocabulary
    single, rest, trained = fitted.single, fitted.rest, fitted.trained
    schema = f"{_ASKED}, {_kept(kind)}"
    whole = arrow_schema(schema)

    def own(strata: list[int], numbers: list[int], texts: list[np.ndarray], n: int) -> tuple[np.ndarray, list[tuple]]:
        """Bits of ``n`` texts, of which those with ``numbers`` have words, but for the pairs that are not at hand; and these."""
        sizes = np.array([*map(len, texts)], np.int64)
        code = np.sort(vocabulary.pairs(strata, texts) << TEXT_BITS | np.repeat(np.array(numbers, np.int64), sizes))
        edges = np.flatnonzero(np.diff(code, prepend=-1))
        times = np.diff(edges, append=len(code))
        pair, text = code[edges] >> TEXT_BITS, code[edges] & ((1 << TEXT_BITS) - 1)
        bits = np.bincount(text, (single[pair & ((1 << BITS) - 1)] + rest[pair >> BITS]) * times, n)
        if len(known):
            at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
            here = known[at] == pair
            bits += np.bincount(text[here], (known_gain[at] * times)[here], n)
            pair, text, times = pair[~here], text[~here], times[~here]
        asked = passes(words, _mixed(pair))
        pair, text, times = pair[asked], text[asked], times[asked]
        return bits, [(b, pair[at], times[at], text[at]) for b, at in _buckets(pair, buckets)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        read, batch = Texts(), TaskContext.get().partitionId() << 32
        ids, seen, likes, chars, n_words, langs, asking, waiting, size = [], {}, [], [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            n = len(likes)
            bits, parts = own([langs[i] for i in asking], asking, waiting, n)
            none = np.ones(n, bool)
            none[asking] = False
            kept = {
                "ids": pa.concat_arrays(ids),
                "langs": pa.array(langs, pa.int32()),
                "chars": pa.array(chars, pa.int64()),
                "n_words": pa.array(n_words, pa.int64()),
                "likes": pa.array(likes, pa.int32()),
                "bits": pa.array(bits, pa.float64(), mask=none),
            }
            return _rows_of(whole, batch, n, parts, kept, (batch + (batch >> 32)) % buckets)

        for b in batches:
            for start in range(0, b.num_rows, 64):
                part = b.slice(start, 64)
                ids.append(part.column(part.schema.get_field_index("_id")))
                for lang, t in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("_lang", "_text"))):
                    i, t = len(likes), t or ""
                    like = seen.setdefault((lang, xxhash.xxh128_digest(t.encode("utf-8", "surrogatepass"))), i)
                    keys = read.keys(lang, t) if like == i else None
                    likes.append(like)
                    langs.append(lang)
                    chars.append(len(t))
                    n_words.append(n_words[like] if keys is None else len(keys))
                    if keys is not None and len(keys) and trained[lang]:
                        asking.append(i)
                        waiting.append(keys)
                        size += len(keys)
                if size >= FLUSH or len(likes) > (1 << TEXT_BITS) - 64:
                    yield out()
                    batch += 1
                    ids, seen, likes, chars, n_words, langs, asking, waiting, size = [], {}, [], [], [], [], [], [], 0
        if likes:
            yield out()

    answered = f"batch long, more array<double>, {_kept(kind)}"
    out_schema = arrow_schema(answered)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, gain = None, [], None
        for b in batches:
            column = {f: b.column(i) for i, f in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                bucket, batch, n, size, pairs, times, texts = (column[f][i].as_py() for f in ("bucket", "batch", "n", "size", "pairs", "times", "texts"))
                if bucket != now:
                    now, table, gain = bucket, [], None
                if batch < 0:
                    table.append((unpacked_pairs(pairs, size), unpacked(times, size)))
                    continue
                more = None
                if pairs is not None:
                    if gain is None:
                        table = _summed([np.zeros(0, np.int64), *(x for x, _ in table)], [np.zeros(0, np.int64), *(x for _, x in table)])
                        gain, table = fitted.gains(*table), table[0]
                    pair = unpacked_pairs(pairs, size)
                    if not len(table):
                        continue
                    at = np.minimum(np.searchsorted(table, pair), len(table) - 1)
                    here = table[at] == pair
                    more = np.bincount(unpacked(texts, size)[here], (gain[at] * unpacked(times, size))[here], n)
                columns = [pa.array([batch], pa.int64()), pa.array([more], pa.list_(pa.float64())), *(column[f].slice(i, 1) for f in _KEPT)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    result = f"_id {kind}, _lang int, chars long, n_words long, bits double"
    result_schema = arrow_schema(result)

    def finish(group: pa.Table) -> pa.Table:
        """The texts of a batch, with all that was answered added up."""
        group = group.combine_chunks()
        kept = group.filter(group["ids"].is_valid())
        ids, langs, chars, n_words, likes, bits = (kept[f].combine_chunks().flatten() for f in _KEPT)
        more = np.zeros(len(ids))
        for x in group["more"].combine_chunks().drop_null():
            more += x.values.to_numpy()
        like = likes.to_numpy()
        total = pa.array((bits.fill_null(0.0).to_numpy() + more)[like], pa.float64(), mask=bits.is_null().to_numpy(zero_copy_only=False)[like])
        columns = [ids, langs, chars, n_words, total]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, result_schema)], schema=result_schema)

    asked = scan(docs.select("_id", "_lang", "_text"), ask, schema).unionByName(_dealt_table(others, buckets, kind))
    met = scan(asked.repartition(2 * buckets, "bucket").sortWithinPartitions("bucket", "batch"), answer, answered)
    return met.groupBy("batch").applyInArrow(finish, result)


def fit(texts: DataFrame, strata: int, vocabulary: int = VOCABULARY) -> tuple[Model, DataFrame]:
    """The model of ``texts`` (``_lang, _text``; languages below ``strata``), and the counts of its pairs."""
    counted = word_counts(texts)
    kept = counted.where(heavy(counted, "c", vocabulary)).select("_lang", "word").toArrow()
    order = np.argsort(kept.column(1).to_numpy())
    known = Vocabulary(strata, kept.column(1).to_numpy()[order], kept.column(0).to_numpy()[order])
    pairs = pair_counts(texts, known)
    return model(counted, pairs, known), pairs


def length_class(chars: Column) -> Column:
    out = F.lit(0)
    for end in LENGTHS:
        out = out + (chars > end).cast("int")
    return out


def thresholds(held: DataFrame, quantile: float) -> DataFrame:
    """``_lang, _class, threshold`` of the held-out perplexities; -1 stands for all classes, or all languages. A few rows a language."""
    levels = [(F.col("_lang"), F.col("_class")), (F.col("_lang"), F.lit(-1)), (F.lit(-1), F.lit(-1))]
    each = F.explode(F.array(*(F.struct(a.alias("_lang"), b.alias("_class")) for a, b in levels)))
    spread = held.select(each.alias("_at"), "perplexity").select("_at.*", "perplexity")
    enough = spread.groupBy("_lang", "_class").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_HELD).drop("_n")
    return settle(quantiles(spread, ["_lang", "_class"], "perplexity", {"threshold": quantile}).join(enough, ["_lang", "_class"]), "thresholds")


def score(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quantile: float = QUANTILE,
    vocabulary: int = VOCABULARY,
    frequent: int = FREQUENT,
) -> DataFrame:
    """``doc_id, perplexity`` (a word), ``threshold`` (NULL: none) and ``kept``, for every document."""
    raw = docs.select(quoted(doc_id).alias("_id"), quoted(lang).alias("_name"), quoted(text).alias("_text"))
    good = settle(trusted_ids(labels), "trusted")
    n_good = good.count()
    common = of(raw.select("_id", "_name"), good, n_good).where("_name IS NOT NULL").groupBy("_name").count().where(F.col("count") >= MIN_TRUSTED)
    names = [r[0] for r in common.orderBy(F.desc("count"), "_name").limit(STRATA).collect()]
    narrow = raw.select("_id", stratum(F.col("_name"), names).alias("_lang"), "_text")
    training = of(narrow, good.where(fold(F.col("_id")) != HELD_OUT), n_good)
    fitted, pairs = fit(training, len(names) + 1, vocabulary)
    bits = log_probabilities(narrow, fitted, pairs, frequent)
    perplexity = F.round(F.pow(F.lit(2.0), -F.col("bits") / F.col("n_words")), 6)
    scored = bits.select("_id", "_lang", "n_words", length_class(F.col("chars")).alias("_class"), perplexity.alias("perplexity"))
    scored = settle(scored, "perplexity")
    held = of(scored.where(fold(F.col("_id")) == HELD_OUT), good, n_good).where("perplexity IS NOT NULL")
    limits, out, levels = thresholds(held, quantile), scored, []
    for keys in (["_lang", "_class"], ["_lang"], []):
        name = "_by" + "".join(keys)
        levels.append(name)
        rest = [k for k in ("_lang", "_class") if k not in keys]
        part = limits.where(F.lit(True) if not rest else " AND ".join(f"{k} = -1" for k in rest)).select(*keys, F.col("threshold").alias(name))
        part = F.broadcast(part)  # a row for each of 256 languages and seven classes at most
        out = out.join(part, keys, "left") if keys else out.join(part, F.lit(True), "left")
    out = out.withColumn("threshold", F.when(F.col("perplexity").isNotNull(), F.coalesce(*levels)))
    kept = (F.col("n_words") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select(F.col("_id").alias("doc_id"), "perplexity", "threshold", kept.alias("kept"))
