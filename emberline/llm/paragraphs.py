"""Substring dedup: paragraphs that repeat, exactly or nearly, found by MinHash banding.

A paragraph is a line of ``MIN_WORDS`` words or more. Its MinHash signature over five-word shingles is cut into bands: 8 bands
of 3 rows, so that a pair at the threshold of 0.8 collides with probability 0.997, one at 0.3 with 0.2. Paragraphs
that collide are joined and verified by the exact Jaccard similarity of their shingle sets; clusters are connected components
of verified pairs. In each cluster the first paragraph (smallest document id, then place) stays, the others are removed.

What repeats inside longer or differently broken lines is found by segments: the words of a text, line breaks aside, are cut
where the hash of the last ``CONTEXT`` words is the least within ``RADIUS`` words on both sides (5 words a segment at least, 9
on average), so that a passage is cut alike wherever it stands but for its first and last words. Neighbouring segments that stand
side by side elsewhere too are a chain; a segment that differs may lie between two such. A chain is compared with its
first copy word by word beyond both ends, and what is alike there belongs to it. A passage is a chain of
``MIN_PASSAGE`` words or more; the first copy of each of its segments stays. Shorter repeats are no passages and stay everywhere.
Lines go first: a segment of which half or more lies in removed lines is out of the count. In scripts without spaces a character is a word.

Equal paragraphs are one node from the start. One pass cuts the texts and writes places, identities and bands; later
passes read only texts that hold colliding paragraphs, or ends of chains. No pairs are written (see ``links``).

Edge cases: NULL and short texts have no paragraphs; a repeated row repeats its paragraphs, the later is removed; a NULL id comes
after all others; copies within one document count; case and punctuation between words do not matter, numbers are words. A removed passage has no
paragraph number (NULL), its cluster is the identity of its first removed segment, and its span can overlap that of a removed line.
Other columns, whatever their names, are not read.
"""

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm import links
from emberline.llm.common import arrow_schema, key_filter, passes, rows, scan, ship, worker_state
from emberline.operators.lineage import settle
from emberline.operators.skew import lookup

ship(__name__)

MIN_WORDS, SHINGLE, SIMILARITY = 8, 5, 0.8
BANDS, BAND_ROWS = 8, 3
#: Words of a passage at least, and of a chain of whole segments that is worth comparing.
MIN_PASSAGE, MIN_CHAIN = 40, 12
_BETWEEN = re.compile(r"[\W_]+")
#: Of segments: words that a cut depends on, and how far around it no other cut is. Words compared beyond a chain's end: more
#: would hold a cut, and so another segment of the chain. Characters that are cut at once, unless one text has more.
CONTEXT, RADIUS, REACH, AT_ONCE = 3, 4, 48, 1 << 18
#: Thai to Myanmar, Khmer, kana and ideographs: scripts without spaces.
_ALONE = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00))
_PLANES = 0x20000


_TURN = np.cumprod(np.full(SHINGLE, 0x9E3779B97F4A7C15, np.uint64))


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 between words, 1 in a word, 2 a word of its own; and a hash of the lower case. Beyond ``_PLANES`` there are ideographs."""
    every = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(_PLANES)]
    kind = np.array([not _BETWEEN.match(c) for c in every] + [2], np.uint8)
    for start, end in _ALONE:
        kind[start:end] *= 2
    lower = np.array([ord(c.lower()[0]) for c in every] + [0], np.uint64)
    with np.errstate(over="ignore"):
        return kind, _mixed(lower + np.uint64(1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(x: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each run of ``n`` elements from ``start`` on."""
    total = int(n.sum())
    offset = np.cumsum(n) - n
    place = np.arange(total) - np.repeat(offset, n)
    powers = np.cumprod(np.full(int(n.max()), 0x9E3779B97F4A7C15, np.uint64))
    side_by_side = np.array_equal(start - start[0], offset)
    some = x[start[0] : start[0] + total] if side_by_side else x[np.repeat(start, n) + place]
    return _mixed(np.add.reduceat(some * powers[place], offset) + n.astype(np.uint64))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of ``n``."""
    return np.lib.stride_tricks.sliding_window_view(x, n).min(axis=1)


class Words(NamedTuple):
    """The words of some texts: text, places in characters, hash, line break count; and where each text begins."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    word: np.ndarray
    line: np.ndarray
    begin: np.ndarray
    breaks: np.ndarray


def words_of(texts: list[str | None]) -> Words | None:
    kind, hashed = worker_state("paragraph_letters", _letters)
    codes = np.frombuffer("\n".join([t or "" for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
    begin = np.cumsum([0] + [len(t or "") + 1 for t in texts])
    sort = kind.take(codes, mode="clip")
    inside = np.flatnonzero(sort)
    if not len(inside):
        return None
    apart, alone = inside[1:] != inside[:-1] + 1, sort[inside] == 2
    if alone.any():
        apart |= alone[1:] | alone[:-1]
    edge = np.concatenate([[0], np.flatnonzero(apart) + 1])
    n = np.diff(np.append(edge, len(inside)))
    first, last = inside[edge], inside[edge + n - 1]
    letters = codes[inside]
    letter = hashed.take(letters, mode="clip")
    with np.errstate(over="ignore"):
        beyond = letters >= _PLANES
        if beyond.any():
            letter[beyond] = _mixed(letters[beyond].astype(np.uint64) + np.uint64(1))
        word = _hashes(letter, edge, n)
    breaks = np.append(np.flatnonzero(codes == 10), len(codes))
    text = np.searchsorted(begin, first, side="right") - 1
    return Words(text, first, last, word, np.searchsorted(breaks, first), begin, breaks)


def _lines(w: Words, min_words: int) -> tuple[np.ndarray, ...]:
    """First word, number of words, identity of the lines that count."""
    edge = np.flatnonzero(np.concatenate([[True], w.line[1:] != w.line[:-1]]))
    n = np.diff(np.append(edge, len(w.line)))
    a, n = edge[n >= min_words], n[n >= min_words]
    return (a, n, _hashes(w.word, a, n).view(np.int64)) if len(a) else (a, n, np.zeros(0, np.int64))


def _segments(w: Words) -> tuple[np.ndarray, ...]:
    """First word, number of words, number in the text, identity."""
    word, text = w.word, w.text
    edge = np.searchsorted(text, np.arange(len(w.begin)))  # first word of each text
    place, left = np.arange(len(word)) - edge[text], edge[text + 1] - np.arange(len(word)) - 1
    ends = np.zeros(len(word), bool)
    if len(word) > 2 * RADIUS + CONTEXT:
        n = len(word) - CONTEXT + 1
        with np.errstate(over="ignore"):
            g = _mixed(sum(word[k : n + k] * _TURN[k] for k in range(CONTEXT)) + np.uint64(CONTEXT))
        g = np.concatenate([np.zeros(CONTEXT - 1, np.uint64), g])  # by the last word
        near = _least(g, RADIUS)
        i = np.arange(RADIUS, len(word) - RADIUS)
        ends[i] = (g[i] < near[i - RADIUS]) & (g[i] <= near[i + 1]) & (place[i] >= RADIUS + CONTEXT - 1) & (left[i] > RADIUS)
    ends |= left == 0
    b = np.flatnonzero(ends)
    a = np.concatenate([[0], b[:-1] + 1])
    number = np.arange(len(a)) - np.searchsorted(text[a], np.arange(len(w.begin)))[text[a]]
    return a, b - a + 1, number, _hashes(word, a, b - a + 1).view(np.int64)


def _flat_shingles(w: Words, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the word runs, one after the other, and where each run's begin."""
    size = n - SHINGLE + 1
    with np.errstate(over="ignore"):
        every = sum(w.word[k : len(w.word) - SHINGLE + 1 + k] * _TURN[k] for k in range(SHINGLE))
    first = np.cumsum(size) - size
    return every[np.repeat(a - first, size) + np.arange(int(size.sum()))], first



def _portions(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > AT_ONCE:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t or "")
    if texts:
        yield start, texts[start:]


_RANDOM = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 2 * BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_SPREAD = np.array([3 * i + 0x9E3779B97F4A7C15 for i in range(BAND_ROWS)], np.uint64) | np.uint64(1)


def band_keys(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Band keys of each shingle set (sets x bands)."""
    with np.errstate(over="ignore"):
        n = BANDS * BAND_ROWS
        mixed = flat ^ (flat >> np.uint64(31))
        least = np.stack([np.minimum.reduceat((mixed * _RANDOM[i] + _RANDOM[n + i]) >> np.uint64(16), first) for i in range(n)], axis=1)
        key = (least.reshape(len(first), BANDS, BAND_ROWS) * _SPREAD).sum(axis=2, dtype=np.uint64)
        key = (key + np.arange(BANDS, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return (key ^ (key >> np.uint64(32))).view(np.int64)


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    text = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("_doc"), F.xxhash64(text).alias("_key"), text.alias("_text"))


def occurrences(narrow: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every line that counts and every segment: ``doc_id, _doc, _key, paragraph, start, length, words, identity, line, last, seq, bands``.

    Places are in characters. ``_doc`` numbers the rows, ``_key`` the texts. Lines have ``paragraph`` and ``bands``; segments
    have ``seq``, and their first and last line in ``line`` and ``last``.
    """
    kind = narrow.schema["doc_id"].dataType.simpleString()
    ddl = (
        f"doc_id {kind}, _doc long, _key long, paragraph int, start long, length long, words int, identity long, line int, last int,"
        " seq int, bands array<long>"
    )
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, numbers, keys, texts in rows(batches, "doc_id", "_doc", "_key", "_text"):
            ids, numbers, keys = (pa.array(v, f.type) for v, f in zip((ids, numbers, keys), schema))
            for start, part in _portions(texts):
                w = words_of(part)
                if w is None:
                    continue
                base = np.searchsorted(w.breaks, w.begin)  # line breaks before each text, those between texts included

                def rows_of(a, n, from_, to, identity, paragraph, seq, bands):
                    own = w.text[a]
                    at = pa.array(own + start)
                    line, last = w.line[a] - base[own], w.line[a + n - 1] - base[own]
                    none = pa.nulls(len(a), pa.int32())
                    values = [ids.take(at), numbers.take(at), keys.take(at), line if paragraph else none, from_ - w.begin[own], to - from_, n, identity, line, last]
                    values += [none if seq is None else seq, pa.nulls(len(a), schema[-1].type) if bands is None else bands]
                    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

                a, n, identity = _lines(w, min_words)
                if len(a):
                    _, one, back = np.unique(identity, return_index=True, return_inverse=True)
                    keyed = band_keys(*_flat_shingles(w, a[one], n[one]))[back]
                    bands = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * BANDS), pa.array(keyed.ravel())).cast(schema[-1].type)
                    end = np.searchsorted(w.breaks, w.first[a])
                    begin = np.where(end > 0, w.breaks[end - 1] + 1, 0)
                    yield rows_of(a, n, begin, w.breaks[end], identity, True, None, bands)
                a, n, seq, identity = _segments(w)
                long = n > RADIUS
                a, n, seq, identity = a[long], n[long], seq[long], identity[long]
                if len(a):
                    yield rows_of(a, n, w.first[a], w.last[a + n - 1] + 1, identity, False, seq, None)

    return scan(narrow, run, ddl)


def _kept_texts(texts: list[str | None], keys: list[int], wanted: np.ndarray) -> tuple[list[str | None], list[int]]:
    at = np.flatnonzero(passes(wanted, np.array(keys, np.int64))).tolist() if keys else []
    return [texts[i] for i in at], [keys[i] for i in at]


def _shingled(narrow: DataFrame, wanted: np.ndarray, texts: np.ndarray, min_words: int) -> DataFrame:
    """``node, value``: paragraphs that pass a filter, with their shingles, from texts that pass another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, part in rows(batches, "_key", "_text"):
            for _, some in _portions(_kept_texts(part, keys, texts)[0]):
                w = words_of(some)
                if w is None:
                    continue
                a, n, identity = _lines(w, min_words)
                identity, one = np.unique(identity, return_index=True)
                hit = passes(wanted, identity)
                if not hit.any():
                    continue
                flat, first = _flat_shingles(w, a[one][hit], n[one][hit])
                sets = [np.unique(x).view(np.int64) for x in np.split(flat, first[1:])]
                yield pa.RecordBatch.from_pydict({"node": pa.array(identity[hit]), "value": pa.array(sets, pa.list_(pa.int64()))})

    return scan(narrow.select("_key", "_text"), run, "node long, value array<long>")


def _passing(df: DataFrame, column: str, wanted: np.ndarray) -> DataFrame:
    """Rows whose ``column`` passes a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = b.column(b.schema.get_field_index(column)).to_numpy()
            yield b.filter(pa.array(passes(wanted, value))) if b.num_rows else b

    return df.mapInArrow(run, df.schema)


def _similar(least: float) -> links.Linked:
    def linked(values: pa.Array, some: np.ndarray, others: np.ndarray) -> np.ndarray:
        take = values.take(pa.array(others))
        flat, size = take.flatten().to_numpy(), take.value_lengths().to_numpy()
        first = np.cumsum(size) - size
        out = np.zeros((len(some), len(others)), bool)
        for k, i in enumerate(some.tolist()):
            own = values[i].values.to_numpy()  # sorted as unsigned numbers
            both = np.add.reduceat(np.isin(flat, own), first, dtype=np.int64)
            out[k] = both >= least * (len(own) + size - both)
        return out

    return linked


def clusters(narrow: DataFrame, lines: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``identity, cluster`` of the paragraphs that are similar to a different one."""
    keyed = lines.select(F.explode("bands").alias("key"), F.col("identity").alias("node"))
    counted = keyed.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b"))
    colliding = settle(counted.where("_a <> _b").select("key"), "paragraph-bands")
    met = _passing(keyed, "key", key_filter(colliding, "key")).dropDuplicates(["key", "node"]).join(colliding, "key", "left_semi")
    met = settle(met, "colliding-paragraphs")
    nodes = key_filter(met.select("node").distinct(), "node")
    texts = key_filter(_passing(lines.select("identity", "_key"), "identity", nodes).select("_key").distinct(), "_key")
    sets = _shingled(narrow, nodes, texts, min_words).dropDuplicates(["node"])
    found = met.join(sets, "node").select("key", "node", "value")
    return links.roots(narrow.sparkSession, links.links(found, _similar(similarity))).toDF("identity", "cluster")


def _removed_lines(lines: DataFrame, clusters: DataFrame) -> DataFrame:
    """All but the first line of each cluster."""
    named = lookup(lines.drop("bands", "seq"), clusters, ["identity"], "left").withColumn("cluster", F.coalesce("cluster", "identity"))
    place = F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "paragraph", "_doc")
    first = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.min(place).alias("_first")).where("members > 1")
    met = lookup(named, settle(first, "first-lines"), ["cluster"], "inner", weight=16).where("_doc <> _first._doc OR paragraph <> _first.paragraph")
    return met.select(
        "doc_id", "paragraph", "start", "length", "cluster", "members",
        F.col("_first.doc_id").alias("kept_doc_id"), F.col("_first.paragraph").alias("kept_paragraph"), "_doc",
    )


# ---- passages -------------------------------------------------------------------------------------------


def _outside(some: DataFrame, lines: DataFrame) -> DataFrame:
    """Segments of which less than half lies in removed ``lines``, with ``_cut``: is any of it there?"""
    cut = lines.select("_doc", F.col("paragraph").alias("_line"), F.col("start").alias("_a"), (F.col("start") + F.col("length")).alias("_b"))
    met = some.select("seq", "_doc", "start", "length", F.explode(F.sequence("line", "last")).alias("_line")).join(cut, ["_doc", "_line"])
    inside = F.least(F.col("start") + F.col("length"), "_b") - F.greatest("start", "_a")
    lost = met.groupBy("_doc", "seq").agg(F.sum(inside).alias("_lost"))
    left = some.join(lost, ["_doc", "seq"], "left").withColumn("_lost", F.coalesce("_lost", F.lit(0)))
    return left.where(2 * F.col("_lost") < F.col("length")).withColumn("_cut", F.col("_lost") > 0).drop("_lost", "line", "last")


def _repeated(segments: DataFrame) -> DataFrame:
    """Segments that occur more than once."""
    again = segments.groupBy("identity").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("identity")
    again = settle(again, "repeated-identities")
    return _passing(segments, "identity", key_filter(again, "identity")).join(again, "identity", "left_semi")


def _chained(left: DataFrame) -> DataFrame:
    """``left`` (repeated segments) with ``_chain``, and the chain's words: neighbours, or next but one, that are so elsewhere too."""
    order = Window.partitionBy("_doc").orderBy("seq")
    apart = F.lead("seq").over(order) - F.col("seq")
    paired = left.withColumn("_pair", F.when(apart <= 2, F.xxhash64("identity", F.lead("identity").over(order), apart)))
    paired = settle(paired, "paired-segments")
    pairs = paired.where("_pair IS NOT NULL")
    again = pairs.groupBy("_pair").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_pair", F.lit(True).alias("_held"))
    alone = F.xxhash64("_doc", "seq")  # rows without a pair are not dealt to one task
    held = paired.withColumn("_pair", F.coalesce("_pair", alone)).join(again, "_pair", "left")
    begins = F.when(F.lag(F.coalesce("_held", F.lit(False))).over(order), 0).otherwise(1)
    chained = held.withColumn("_chain", F.sum(begins).over(order))
    of = Window.partitionBy("_doc", "_chain")
    return chained.withColumn("_words", F.sum("words").over(of)).drop("_pair", "_held")


def _contexts(narrow: DataFrame, edges: DataFrame) -> DataFrame:
    """``_key, start, before, before_at, after, after_at``: the words beyond segments on the sides that ``edges`` names, outwards.

    ``edges`` has ``_key, start, identity`` and ``_after``, the side. A side that it does not name is NULL.
    """
    # The low bit of a place is the side; text keys are hashes, so places of different texts spread by them.
    place = F.col("_key").bitwiseXOR(2 * F.col("start") + F.col("_after").cast("long"))
    wanted, texts = key_filter(edges.select("identity").distinct(), "identity"), key_filter(edges.select("_key").distinct(), "_key")
    places = key_filter(edges.select(place.alias("place")), "place")
    ddl = "_key long, start long, before array<long>, before_at array<int>, after array<long>, after_at array<int>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, part in rows(batches, "_key", "_text"):
            some, keys = _kept_texts(part, keys, texts)
            for at, portion in _portions(some):
                w = words_of(portion)
                if w is None:
                    continue
                a, n, _, identity = _segments(w)
                hit = np.flatnonzero(passes(wanted, identity))
                own = w.text[a[hit]]
                key, start = np.array(keys[at : at + len(portion)], np.int64)[own], w.first[a[hit]] - w.begin[own]
                sides = np.stack([passes(places, key ^ (2 * start + side)) for side in (0, 1)])
                some_side = sides.any(axis=0)
                hit, sides = hit[some_side], sides[:, some_side]
                if not len(hit):
                    continue
                edge = np.searchsorted(w.text, np.arange(len(w.begin)))
                hashes = w.word.view(np.int64)
                out = []
                for i, before, after in zip(hit.tolist(), *sides.tolist()):
                    own, first, end = int(w.text[a[i]]), int(a[i]), int(a[i] + n[i])
                    b, c = max(first - REACH, int(edge[own])), min(end + REACH, int(edge[own + 1]))
                    base = w.begin[own]
                    out.append(
                        (keys[at + own], int(w.first[first] - base))
                        + ((hashes[b:first][::-1], w.first[b:first][::-1] - base) if before else (None, None))
                        + ((hashes[end:c], w.last[end:c] + 1 - base) if after else (None, None))
                    )
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return scan(narrow.select("_key", "_text"), run, ddl).dropDuplicates(["_key", "start"])


def passages(narrow: DataFrame, segments: DataFrame, lines: DataFrame) -> DataFrame:
    """Passages to remove besides the removed ``lines``, as ``removals`` gives them."""
    some = settle(_repeated(segments.drop("bands", "paragraph")), "repeated-segments")
    chained = settle(_chained(_outside(some, lines)).where(F.col("_words") >= MIN_CHAIN), "chains")
    place = F.struct("_cut", F.col("doc_id").isNull().alias("_last"), "doc_id", "_doc", "seq", "_key", "start", (F.col("start") + F.col("length")).alias("_end"))
    first = chained.groupBy("identity").agg(F.count(F.lit(1)).alias("members"), F.min(place).alias("_first")).where("members > 1")
    met = lookup(chained, settle(first, "first-segments"), ["identity"], "inner", weight=16).where("_doc <> _first._doc OR seq <> _first.seq")
    met = settle(met.withColumn("_to", F.col("start") + F.col("length")), "later-copies")
    # Removed segments of a chain, side by side or next but one, are one stretch; a stretch may grow where its chain ends.
    order = Window.partitionBy("_doc", "_chain").orderBy("seq")
    stretch = F.sum(F.when(F.col("seq") - F.lag("seq").over(order) <= 2, 0).otherwise(1)).over(order)
    cells = F.struct("seq", "start", "_to", "identity", "members", "_key", "_first", "words")
    runs = met.withColumn("_stretch", stretch).groupBy("_doc", "doc_id", "_chain", "_stretch").agg(
        F.min_by(cells, "seq").alias("_a"), F.max_by(cells, "seq").alias("_b"), F.sum("words").alias("_words")
    )
    span = chained.groupBy("_doc", "_chain").agg(F.min("seq").alias("_from"), F.max("seq").alias("_last"))
    runs = settle(runs.join(span, ["_doc", "_chain"]), "passage-stretches")
    # Words beyond a stretch's end count only where the chain ends too, and only on that side.
    sides = [("_a", runs.where("_a.seq = _from"), False), ("_b", runs.where("_b.seq = _last"), True)]
    edges = [
        df.select(F.col(f"{e}{at}._key").alias("_key"), F.col(f"{e}{at}.start").alias("start"), F.col(f"{e}.identity").alias("identity"), F.lit(after).alias("_after"))
        for e, df, after in sides
        for at in ("", "._first")
    ]
    around = settle(_contexts(narrow, reduce(DataFrame.union, edges)), "contexts")

    def grown(df: DataFrame, end: str, side: str) -> DataFrame:
        """``df`` with the words that a stretch's end has in common with the first copy beyond it, and their outer place."""
        around_side = around.where(F.col(side).isNotNull())
        own = around_side.select(F.col("_key").alias("_ok"), F.col("start").alias("_os"), F.col(side).alias("_own"), F.col(f"{side}_at").alias("_own_at"))
        other = around_side.select(F.col("_key").alias("_fk"), F.col("start").alias("_fs"), F.col(side).alias("_other"))
        at = df.withColumns({"_ok": F.col(f"{end}._key"), "_os": F.col(f"{end}.start"), "_fk": F.col(f"{end}._first._key"), "_fs": F.col(f"{end}._first.start")})
        both = lookup(at.join(own, ["_ok", "_os"], "left"), other, ["_fk", "_fs"], "left", weight=128)
        differ = F.array_position(F.zip_with("_own", "_other", lambda x, y: ~F.coalesce(x == y, F.lit(False))), True)
        alike = F.when(differ > 0, differ - 1).otherwise(F.size("_own"))
        edge = F.col(f"{end}.seq") == F.col("_from" if end == "_a" else "_last")
        n = F.when(edge & F.col("_own").isNotNull() & F.col("_other").isNotNull(), alike).otherwise(0).cast("int")
        return both.withColumn(f"_n{end}", n).withColumn(f"_at{end}", F.get("_own_at", F.col(f"_n{end}") - 1)).drop("_own", "_own_at", "_other", "_ok", "_os", "_fk", "_fs")

    whole = grown(grown(runs, "_a", "before"), "_b", "after").where(F.col("_words") + F.col("_n_a") + F.col("_n_b") >= MIN_PASSAGE)
    start = F.when(F.col("_n_a") > 0, F.col("_at_a")).otherwise(F.col("_a.start"))
    end = F.when(F.col("_n_b") > 0, F.col("_at_b")).otherwise(F.col("_b._to"))
    return whole.select(
        "doc_id", F.lit(None).cast("int").alias("paragraph"), start.alias("start"), (end - start).alias("length"), F.col("_a.identity").alias("cluster"),
        F.col("_a.members").alias("members"), F.col("_a._first.doc_id").alias("kept_doc_id"), F.lit(None).cast("int").alias("kept_paragraph"), "_doc",
    )


def removals(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """Every paragraph and passage to remove: ``doc_id, paragraph, start, length``, its ``cluster``, and the one that stays.

    ``members`` is the number of paragraphs of the cluster, over all documents.
    """
    narrow = _narrow(docs, doc_id, text)
    every = settle(occurrences(narrow, min_words), "paragraphs")
    lines = every.where("paragraph IS NOT NULL")
    removed = settle(_removed_lines(lines, clusters(narrow, lines, min_words, similarity)), "removed-lines")
    return removed.union(passages(narrow, every.where("paragraph IS NULL"), removed)).drop("_doc")
