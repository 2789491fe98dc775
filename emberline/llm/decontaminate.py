"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of a partition. Its words become numbers of the benchmark's vocabulary; stretches of words that the
benchmark does not have, or that are shorter than any test phrase, cannot hold an occurrence and stay out of the
index. The rest is suffix-sorted; its Burrows-Wheeler transform goes into a wavelet tree. All test phrases are
searched backwards at once, occurrences are located by walking back to sampled suffix positions, and their words
merge into removal spans. Nothing is shuffled.

The benchmark is searched in blocks of a bounded number of words, each sent to the tasks that scan all documents.

Edge cases: a NULL or empty text has no words and no hits; an item without words has no windows; items repeated under
one id count once; an item with a NULL id is matched and named by an empty string; an empty benchmark finds nothing;
documents with equal or NULL ids are judged each by its own text.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import arrow_schema, carried, scan, ship, taken_back
from emberline.operators.lineage import settle

ship(__name__)

WINDOW = 10
#: Words of one benchmark block; passes over the documents before an intermediate result is written.
BLOCK_WORDS, PASSES = 1_000_000, 4
#: Text bytes of one index (at least one document), words of an indexed stretch, distance of sampled positions.
SHARD_BYTES, STRETCH, SAMPLE = 16 << 20, 64, 8

#: Everything but ASCII letters, digits and non-ASCII separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Phrases:
    """Windows of a benchmark block as numbers: equal windows once, with the items that have them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set[str]] = {}
        for name, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in split_words(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners.setdefault(tuple(w[i : i + window]), set()).add(name)
        windows = sorted(owners, key=len)
        self.lengths = np.array([len(x) for x in windows], np.int64)
        self.words = np.zeros((len(windows), window), np.int64)  # right-aligned
        for i, x in enumerate(windows):
            self.words[i, window - len(x) :] = x
        self.names = sorted({n for o in owners.values() for n in o})
        number = {n: i for i, n in enumerate(self.names)}
        self.owner_window = np.array([i for i, x in enumerate(windows) for _ in owners[x]], np.int64)
        self.owner_item = np.array([number[n] for x in windows for n in sorted(owners[x])], np.int64)
        self.shortest = int(self.lengths.min(initial=window))


class WaveletTree:
    """Ranks of symbols in a sequence, one bit vector per level (the matrix layout: zeros first, then ones)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((level, ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``end`` entries."""
        start = np.zeros_like(end)
        for level, ones, zeros in self.levels:
            is_one = (symbol >> level) & 1 == 1
            start = np.where(is_one, zeros + ones[start], start - ones[start])
            end = np.where(is_one, zeros + ones[end], end - ones[end])
        return end - start


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Zeros end stretches and are ordered by place, so no comparison crosses them."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + int(ends.sum())).astype(np.int64)
    step, order = 1, np.argsort(rank)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:]
        key = rank * (int(rank.max()) + 1) + ahead
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FmIndex:
    """Stretches of words, each followed by a zero; ``place`` is the word's position in the shard."""

    def __init__(self, symbols: np.ndarray, place: np.ndarray, vocabulary: int):
        order = suffix_order(symbols)
        self.bwt = symbols[order - 1]
        self.tree = WaveletTree(self.bwt, max(1, int(vocabulary).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=vocabulary + 1))])
        starts = np.concatenate([[True], symbols[:-1] == 0])  # no walk leaves its stretch
        self.sampled = (starts | (np.arange(len(symbols)) % SAMPLE == 0))[order]
        self.at = np.cumsum(self.sampled) - 1
        self.position = order[self.sampled]
        self.place = place

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur and their row ranges."""
        which = np.arange(len(words))
        low, high = np.zeros(len(words), np.int64), np.full(len(words), len(self.bwt), np.int64)
        done: list[tuple[np.ndarray, ...]] = []
        for back in range(1, words.shape[1] + 1):
            over = lengths[which] < back
            done.append((which[over], low[over], high[over]))
            which, low, high = which[~over], low[~over], high[~over]
            c = words[which, -back]
            low, high = self.first[c] + self.tree.rank(c, low), self.first[c] + self.tree.rank(c, high)
            live = low < high
            which, low, high = which[live], low[live], high[live]
        done.append((which, low, high))
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Words' places in the shard for rows of the index."""
        found, walked = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[found])
        while len(open_):
            c = self.bwt[found[open_]]
            found[open_] = self.first[c] + self.tree.rank(c, found[open_])
            walked[open_] += 1
            open_ = open_[~self.sampled[found[open_]]]
        return self.place[self.position[self.at[found]] + walked]


def _stretches(ids: np.ndarray, shortest: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of known words that can hold a phrase, cut into overlapping stretches, each with a closing zero."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= shortest
    start, end = start[long], end[long]
    step = STRETCH - window + 1
    count = np.maximum(1, -(-(end - start - window + 1) // step))
    run = np.repeat(np.arange(len(start)), count)
    begin = start[run] + step * (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count))
    size = np.minimum(begin + STRETCH, end[run]) - begin + 1
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = np.repeat(begin, size) + inner
    closing = inner == np.repeat(size, size) - 1
    return np.where(closing, 0, ids[np.minimum(place, len(ids) - 1)]), place


def search_shard(docs: list[np.ndarray], phrases: Phrases, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers per document -> (document, item) pairs as two arrays, and for all words in order whether they are hit."""
    parts = [x for d in docs for x in (d, np.zeros(1, np.int64))]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(docs)), [len(d) + 1 for d in docs])
    hit, none = np.zeros(len(ids) + 1, np.int64), np.zeros(0, np.int64)
    symbols, place = _stretches(ids, phrases.shortest, window)
    if not len(symbols) or not len(phrases.lengths):
        return none, none, hit[:-1][ids >= 0] > 0
    index = FmIndex(symbols, place, len(phrases.vocabulary))
    which, low, high = index.search(phrases.words, phrases.lengths)
    many = high - low
    rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    which, at = np.repeat(which, many), index.locate(rows)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + phrases.lengths[which], -1)
    pairs = np.unique(owner[at] * len(phrases.lengths) + which)
    doc, phrase = np.divmod(pairs, len(phrases.lengths))
    left = np.searchsorted(phrases.owner_window, phrase)
    count = np.searchsorted(phrases.owner_window, phrase, side="right") - left
    own = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found = np.unique(np.repeat(doc, count) * len(phrases.names) + phrases.owner_item[own])
    doc, item = np.divmod(found, max(1, len(phrases.names)))
    return doc, item, np.cumsum(hit[:-1]) > 0


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices whose texts take ``SHARD_BYTES`` at most, or are one row."""
    for b in batches:
        size = np.cumsum([len(x) if x else 0 for x in b.column(b.schema.get_field_index(column)).to_pylist()])
        start = 0
        while start < b.num_rows:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + SHARD_BYTES, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def _merge(hit: np.ndarray, old: list | None) -> list[dict]:
    if old:
        hit = hit.copy()
        for s in old:
            hit[s["start"] : s["end"]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def _pass(docs: DataFrame, phrases: Phrases, text: str, window: int, cut: bool) -> DataFrame:
    """One scan: ``docs`` with the words, spans and items of this block added to those it has; with ``cut`` without them."""
    carried = [f for f in docs.schema.fields if f.name not in ("n_words", "spans", "items")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), FOUND])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = phrases.vocabulary
        for b in _slices(batches, text):
            column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            numbers = []
            for t in column(text).to_pylist():
                w = split_words(t)
                numbers.append(np.fromiter((known.get(x, 0) for x in w), np.int64, len(w)))
            doc, item, hit = search_shard(numbers, phrases, window)
            before = column("spans").to_pylist(), column("items").to_pylist()
            items: list[set[str]] = [set(x or ()) for x in before[1]]
            for d, i in zip(doc.tolist(), item.tolist()):
                items[d].add(phrases.names[i])
            at, spans = 0, []
            for i, d in enumerate(numbers):
                own = hit[at : at + len(d)]
                spans.append(_merge(own, before[0][i]) if before[0][i] or items[i] else [])
                at += len(d) + 1
            counted = [len(d) for d in numbers], spans, [sorted(x) for x in items]
            arrays = [pa.array(v, type=out_schema.field(n).type) for n, v in zip(("n_words", "spans", "items"), counted)]
            values = {f.name: column(f.name) for f in carried}
            if cut and any(spans):
                values[text] = pa.array([cut_words(t, s) if s else t for t, s in zip(column(text).to_pylist(), spans)])
            yield pa.RecordBatch.from_arrays([*values.values(), *arrays], schema=out_schema)

    return scan(docs, run, schema)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, cut: bool = False) -> DataFrame:
    """``docs`` plus ``n_words``, ``spans`` (merged runs of hit words, by word number) and ``items`` (ids that occur).

    With ``cut`` the text comes without the hit words. ``docs`` must not have columns of these three names.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text")
    size = items.select(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0]
    blocks = max(1, -(-int(size or 0) // BLOCK_WORDS))
    empty = F.array().cast("array<struct<start: long, end: long>>"), F.array().cast("array<string>")
    found = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": empty[0], "items": empty[1]})
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k).collect()
        found = _pass(found, Phrases([(x["name"], x["text"]) for x in own], window), text, window, cut and k == blocks - 1)
        if k % PASSES == PASSES - 1 and k < blocks - 1:
            found = settle(found, "decontaminate")
    return found


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def cut_words(text: str, spans: list) -> str:
    """``text`` without the words of the spans, from the first letter to the last; one space stays."""
    words = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : words[s["start"]][0]])
        at = words[s["end"] - 1][1]
    return " ".join([*kept, text[at:]])


_LOWER = {c: c + 32 for c in range(65, 91)}


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", n_chars: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` without the hit words; documents with none left go. ``n_chars`` follows the text if there is such a column."""
    found = find(docs.select(carried(docs, text), F.col(text).alias("_text")), benchmark, "_text", window, cut=True)
    some = F.size("spans") > 0
    back = taken_back(docs, text) | {text: F.col("_text")}
    own = {c: back[c] for c in docs.columns}
    if n_chars in docs.columns:
        length = F.length("_text").cast(docs.schema[n_chars].dataType)
        own[n_chars] = F.when(some, length).otherwise(own[n_chars])
    return found.where(~some | (n_hit(F.col("spans")) < F.col("n_words"))).select(*(v.alias(k) for k, v in own.items()))
