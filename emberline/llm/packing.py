"""Packing token sequences with exact complements.

Documents become token ids and an end mark; longer ones than ``limit`` are cut. How the pieces are combined depends
only on how many there are of each length, a histogram of ``limit`` numbers, so the plan is made from that histogram,
whatever the size of the corpus: it lists patterns (lengths that share a sequence) with a multiplicity. A piece finds
its place from its rank among the pieces of its length.

Edge cases: a NULL or empty text is the end mark alone (one piece of length 1); rows with equal or NULL ids are
separate documents; an empty table gives no pieces; other columns are not read.
"""

import math
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm.common import arrow_schema, rows, scan, ship, worker_state
from emberline.operators.lineage import settle

ship(__name__)

LIMIT, END = 2048, 0
#: Words in each of two generations whose ids a worker keeps, the longest of them, and endings of words.
CACHE_WORDS, CACHE_CHARS, CACHE_TAILS = 200_000, 64, 10_000
#: Fixed value: ASCII punctuation. A run of it behind letters is one tokenizer word.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below lower to one letter each, in Python as in the tokenizer, and take part in no composition.
PLAIN_LETTERS = "\u0130"
#: Python's ``split`` also cuts here; the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Pieces ranked together in one window.
RANK_GROUP = 50_000


class Encoder:
    """Token ids as little-endian bytes. No token spans white space, so ids are kept per word.

    Letters and the punctuation behind them are two tokenizer words, and the tokenizer lowers case itself: such variants
    take their ids from the bare word. New bare words are encoded many at a time and told apart by the word-end
    marks of their tokens. Words are kept in two generations: when the younger is full it becomes the older, whose
    words come back when they are met.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_bare(self, bare: list[str]) -> list[bytes]:
        """Ids of words of letters only."""
        out: list[bytes] = []
        chunks = [bare[i : i + 512] for i in range(0, len(bare), 512)]
        for chunk, data in zip(chunks, self._encode([" ".join(c) for c in chunks])):
            cuts = (np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1).tolist()
            if len(cuts) == len(chunk) and 4 * cuts[-1] == len(data):
                out += [data[4 * i : 4 * j] for i, j in zip([0, *cuts], cuts)]
            else:
                out += self._encode(chunk)
        return out

    def _learn(self, words: set[str]) -> None:
        """Ids of new words into ``known``."""
        known, older, tails = self.known, self.older, self.tails
        back = older.keys() & words
        known.update(zip(back, map(older.__getitem__, back)))
        bare_of, bare, other, new_tails = {}, set(), [], set()
        for w in words - back if back else words:
            core = w.rstrip(PUNCTUATION)
            if core.isalpha() and (core.isascii() or max(core) < PLAIN_LETTERS):
                low = core.lower()
                bare.add(low)
                if low != w:
                    bare_of[w] = low
                    if len(core) < len(w) and (tail := w[len(core) :]) not in tails:
                        new_tails.add(tail)
            else:
                other.append(w)
        if len(tails) + len(new_tails) > CACHE_TAILS:
            tails = self.tails = {}
            new_tails.update(w[len(core) :] for w, core in bare_of.items() if len(core) < len(w))
        tails.update(zip(new_tails, self._encode(list(new_tails))))
        bare.difference_update(known)
        back = older.keys() & bare
        known.update(zip(back, map(older.__getitem__, back)))
        bare = list(bare - back)
        known.update(zip(bare, self._encode_bare(bare)))
        known.update(zip(other, self._encode(other)))
        for w, core in bare_of.items():
            n = len(core)
            known[w] = known[core] if len(w) == n else known[core] + tails[w[n:]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        odd = ODD_SPACE.search("".join(t for t in texts if t))
        split = [[t] if odd and t and ODD_SPACE.search(t) else (t or "").split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        new = set().union(*split).difference(self.known)
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, ws)) for ws in split]
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.known[w]
        return out


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    return [(s, min(limit, n - s)) for s in range(0, n, limit)]


def pieces(
    docs: DataFrame, tokenizer: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and with ``with_ids`` the ids, of a tokenizer given as JSON."""
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"encoder_{zlib.crc32(tokenizer.encode())}", lambda: Encoder(tokenizer))
        for ids, texts in rows(batches, "doc_id", "text", size=256):
            out = []
            for doc, data in zip(ids, encoder.encode(texts)):
                data += end
                for k, (start, length) in enumerate(cut(len(data) // 4, limit)):
                    part = data[4 * start : 4 * (start + length)]
                    out.append((doc, k, start, length, zlib.crc32(part), np.frombuffer(part, "<u4").astype("i4") if with_ids else None))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")[: 5 + with_ids]
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out))), schema=pa_schema)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pa_schema = arrow_schema(schema)
    return scan(narrow, run, schema)


class Sums:
    """An index of the sums of one, two and three available lengths.

    Counts only fall, so a combination that is used up is passed for good: for every sum the index keeps the first pair, and the
    first length of a triple, that may still be there.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.low: dict[int, int] = {}
        self.first: dict[int, int] = {}

    def _there(self, *lengths: int) -> bool:
        return all(self.left[n] >= lengths.count(n) for n in lengths)

    def pair(self, total: int, first: int = 0) -> list[int] | None:
        """Two lengths that add up to ``total``, available beside ``first``."""
        low = self.low.get(total, 1)
        while 2 * low <= total and not self._there(total - low, low):
            low += 1
        self.low[total] = low
        while 2 * low <= total:
            if self._there(total - low, low) if not first else self._there(first, total - low, low):
                return [total - low, low]
            low += 1
        return None

    def triple(self, total: int) -> list[int] | None:
        first = self.first.get(total, total - 2)
        while first > 0:
            if self.left[first] and (rest := self.pair(total - first, first)):
                self.first[total] = first
                return [first, *rest]
            first -= 1
        self.first[total] = 0
        return None

    def exact(self, total: int) -> list[int] | None:
        """The fewest available lengths, three at most, that add up to ``total``, the longest first."""
        return [total] if self.left[total] else self.pair(total) or self.triple(total)


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns and how often each is used; ``counts[n]`` is the number of pieces of length n, ``len(counts) - 1`` the limit.

    The longest piece left opens a sequence. Its gap is closed by one, two or three lengths that fit exactly, if such
    are available; else the longest that fits goes in, and the smaller gap is tried again. A pattern is repeated as
    long as all its lengths last, which uses one of them up: the number of patterns does not depend on the counts.
    """
    left, out = counts.astype(np.int64).copy(), []
    sums = Sums(left)
    while len(lengths := np.flatnonzero(left)):
        pattern = [int(lengths[-1])]
        left[pattern[0]] -= 1
        gap = len(left) - 1 - pattern[0]
        while gap and left[1 : gap + 1].any():
            fill = sums.exact(gap) or [int(np.flatnonzero(left[: gap + 1])[-1])]
            for n in fill:
                left[n] -= 1
            pattern += fill
            gap -= sum(fill)
        use = Counter(pattern)
        more = min(int(left[n]) // k for n, k in use.items())
        for n, k in use.items():
            left[n] -= more * k
        out.append((pattern, more + 1))
    return out


def places(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """For runs of ranks within a length: length and first rank (as one sorted key), first sequence, offset."""
    used: Counter = Counter()
    sequence, out = 0, []
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            out.append(((n << RANK_BITS) + used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    table = np.array(sorted(out), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


RANK_BITS = 48


def _ranked(stored: DataFrame, total: int) -> DataFrame:
    """``_rank``: 0, 1, 2, ... among the pieces of a length. A length that many pieces have is counted in groups."""
    groups = max(1, math.ceil(total / RANK_GROUP))
    grouped = stored.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    sizes = grouped.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("length", "_group").orderBy("_row")
    return grouped.join(first, ["length", "_group"]).withColumn("_rank", F.col("_first") + F.row_number().over(order) - 1)


def pack(cut_pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``cut_pieces`` (with ``length``) plus ``sequence_id`` and ``offset``."""
    stored = settle(cut_pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(limit + 1, np.int64)
    for length, n in stored.groupBy("length").count().collect():
        counts[length] = n
    keys, sequences, offsets = places(plan(counts))
    own = [f for f in stored.schema.fields if f.name != "_row"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = (b.column("length").to_numpy(zero_copy_only=False).astype(np.int64) << RANK_BITS) + b.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, key, side="right") - 1
            columns = [b.column(b.schema.get_field_index(f.name)) for f in own]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])],
                names=[*(f.name for f in own), "sequence_id", "offset"],
            )

    ranked = _ranked(stored, int(counts.sum())).select(*(f.name for f in own), "_rank")
    return scan(ranked, run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, tokenizer, limit, with_ids=with_ids), limit)
