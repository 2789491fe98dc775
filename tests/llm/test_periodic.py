"""Runs against a scan of every period; the query against the same over whole texts."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import periodic, queries


def brute(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 12), st.integers(0, 30))
def test_runs_of_small_alphabets(words, period, start):
    words = words[:start] + [words[start + i % period] if start + i % period < len(words) else 9 for i in range(5 * period)] + words[start:]
    assert periodic.runs_of(words) == brute(words)


def test_words_may_come_in_parts():
    rng = random.Random(3)
    for _ in range(50):
        words = np.array([rng.randrange(2) for _ in range(rng.randrange(1, 200))])
        parts = periodic.Catchers()
        for part in np.array_split(words, rng.randrange(1, 9)):
            parts.append(part)
        assert parts.runs() == brute(words.tolist())


def test_very_long_texts():
    assert periodic.runs_of(["a"] * 300_000) == [(0, 300_000, 1)]
    assert periodic.runs_of(list(range(300_000))) == []
    words = list(range(50_000)) + list(range(1_000)) * 100
    assert periodic.runs_of(words) == brute_of_one(words, 50_000, 1_000)


def brute_of_one(words, start, period):
    while start and words[start - 1] == words[start - 1 + period]:
        start -= 1
    return [(start, len(words) - start, period)]


def test_edges(spark):
    texts = [None, "", " \n\t ", "a a a a a", "a a a a a a", "x a b a b a b a b y", "a b " * 7, "ab " * 3 + "ab\x0bab\x0cab"]
    docs = spark.createDataFrame(
        [(i if i else None, t, "r", 1, "u") for i, t in enumerate(texts)] * 2, "doc_id long, text string, runs string, `a.b` int, _text string"
    )
    got = {(r.doc_id, r.n_words, r.collapsed): [tuple(x) for x in r.runs] for r in periodic.find(docs).collect()}
    assert len(got) == len(texts) and periodic.find(docs).count() == 2 * len(texts)
    assert got[None, 0, ""] == got[1, 0, ""] == got[2, 0, ""] == []
    assert got[3, 5, "a a a a a"] == [] and got[4, 6, "a"] == [(0, 6, 1)] and got[5, 10, "x a b y"] == [(1, 8, 2)]
    assert got[6, 7, "a b"] == [(0, 7, 1)] and got[7, 6, "ab"] == [(0, 6, 1)]
    assert periodic.find(docs.limit(0)).collect() == []


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for i in range(150)] + [(900, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op11_dyadic_runs(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in docs:
        words = planted(i, (text or "").split())
        runs = brute(words)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for j, w in enumerate(words) if j not in gone))
