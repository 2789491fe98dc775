"""Periodic runs of words, found by catching squares with dyadic blocks while words are appended.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least ``max(6, 4 * q)`` words.

For every power of two b the words so far are cut into blocks of b. A completed block has a catcher, which waits for the
block's words to come back p words later, b <= p < 2 * b: each appended word moves the suffix of the last b words on by one,
and that suffix belongs to exactly one distance from exactly one waiting block. A return is the seed of a square of period
p. A run of period p holds at least two neighbouring blocks of its level whole, with their returns, so seeds of one period in
neighbouring blocks are joined, extended word by word, and become one run. Suffixes are compared by hashes; what a hash
lets through is compared word for word.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import arrow_schema, rows, scan, ship

ship(__name__)

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Odd multiplier of the rolling hash, modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of word numbers."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Catchers:
    """The state after the words appended so far: words, hashes of their prefixes, and caught seeds by level."""

    def __init__(self) -> None:
        self.words = np.empty(0, np.int64)
        self.prefix = np.zeros(1, np.uint64)
        self.power = np.ones(1, np.uint64)
        self.seeds: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.next: list[int] = []

    def append(self, ids: np.ndarray) -> None:
        """Advance all catchers by the words ``ids`` (equal words, equal numbers)."""
        if not len(ids):
            return
        powers = np.multiply.accumulate(np.concatenate([self.power[-1:], np.full(len(ids), BASE, np.uint64)]))
        sums = np.cumsum(np.concatenate([self.prefix[-1:], _mixed(ids) * powers[:-1]]))
        self.words = np.concatenate([self.words, ids])
        self.power = np.concatenate([self.power, powers[1:]])
        self.prefix = np.concatenate([self.prefix, sums[1:]])
        n, level = len(self.words), 0
        while LEAST_PERIODS << level <= n:
            b = 1 << level
            if level == len(self.seeds):
                self.seeds.append([])
                self.next.append(b)
            suffix = np.arange(self.next[level], n - b + 1)
            block = (suffix // b - 1) * b
            period = suffix - block
            at = self.prefix[suffix + b] - self.prefix[suffix]
            back = np.flatnonzero(at == (self.prefix[block + b] - self.prefix[block]) * self.power[period])
            self.seeds[level].append((block[back], period[back]))
            self.next[level] = n - b + 1
            level += 1

    def _stretch(self, at: int, p: int) -> tuple[int, int]:
        """The longest [l, r) around ``at`` whose words equal those ``p`` later; empty if the word at ``at`` differs."""
        w, n = self.words, len(self.words) - p
        r, step = at, 64
        while r < n:
            differ = np.flatnonzero(w[r : min(r + step, n)] != w[r + p : min(r + step, n) + p])
            if len(differ):
                r += int(differ[0])
                break
            r, step = min(r + step, n), 2 * step
        l, step = at, 64  # noqa: E741
        while r > at and l > 0:
            first = max(l - step, 0)
            differ = np.flatnonzero(w[first:l] != w[first + p : l + p])
            if len(differ):
                l = first + int(differ[-1]) + 1  # noqa: E741
                break
            l, step = first, 2 * step  # noqa: E741
        return l, r

    def runs(self) -> list[tuple[int, int, int]]:
        """``start, length, period`` of every run, by start and period."""
        found: dict[tuple[int, int], int] = {}
        for level, seeds in enumerate(self.seeds):
            b = 1 << level
            block, period = np.concatenate([s for s, _ in seeds]), np.concatenate([p for _, p in seeds])
            for (start, length), q in found.items():
                if len(block) and length >= 2 * b:  # multiples of a known period inside its run tell nothing new
                    new = (block < start) | (block + period + b > start + length) | (period % q != 0)
                    block, period = block[new], period[new]
            order = np.lexsort((block, period))
            block, period = block[order], period[order]
            joined = (np.diff(period) == 0) & (np.diff(block) == b)
            edge = np.flatnonzero(np.concatenate([[True], ~joined, [True]])) if len(block) else np.zeros(0, int)
            for first, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if end - first < 2:
                    continue
                p, reached = int(period[first]), -1
                for s in block[first:end].tolist():
                    if s < reached:
                        continue
                    start, reached = self._stretch(s, p)
                    length = reached - start + p
                    if reached > start and length >= max(LEAST_WORDS, LEAST_PERIODS * p):
                        found.setdefault((start, length), p)  # levels ascend: the smallest period comes first
        return sorted(((start, length, p) for (start, length), p in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """Runs of one text's words."""
    if len(words) < LEAST_WORDS:
        return []
    numbers: dict = {}
    catchers = Catchers()
    catchers.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64))
    return catchers.runs()


def _scanned(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches, "_id", "_text"):
            counts, runs, kept = [], [], []
            for text in texts:
                words = (text or b"").split()
                found = runs_of(words)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                if found:
                    stays = np.ones(len(words), bool)
                    for s, n, p in found:
                        stays[s + p : s + n] = False
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                kept.append(b" ".join(words).decode())
            columns = [pa.array(v, f.type) for v, f in zip((ids, counts, runs, kept), schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: its runs, and its words without those that a run repeats.

    Words are what stands between ASCII white space. A word goes from ``collapsed`` if any run contains it after the run's
    first period; the rest is joined by single spaces. A NULL or empty text has no words, no runs and an empty ``collapsed``.
    Rows stay rows: repeated ids and NULL ids are answered one by one; runs that end or begin together are all listed.
    Other columns of ``docs``, whatever their names, are not read. No row meets another one: nothing is shuffled, and a
    task holds one text and some 40 bytes a word beside it.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("binary").alias("_text"))
    return scan(narrow, _scanned(arrow_schema(SCHEMA)), SCHEMA)
