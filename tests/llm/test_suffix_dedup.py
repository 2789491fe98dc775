import random
from collections import Counter

from corpus_fixtures import corpus  # noqa: F401
from emberline.llm import suffix_dedup as s


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def test_against_brute_force(spark, corpus, monkeypatch):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [text(n) for n in (60, 75, 120, 400)]
    texts = [text(rng.randint(0, 200)) + rng.choice(shared)[rng.randint(0, 20) :] + text(rng.randint(0, 100)) for _ in range(60)]
    texts += [texts[0], texts[1][:-3], "x" * 300, "xy" * 200, None, "", shared[3] * 3]
    docs = corpus(*texts, ids=[*range(len(texts) - 1), None])
    for length, bits, group in ((64, 19, 20_000), (64, 8, 2), (200, 19, 20_000)):
        monkeypatch.setattr(s, "CHUNK_BITS", bits)
        monkeypatch.setattr(s.repeats, "__defaults__", (s.LENGTH, group))
        rows = {r.doc_id: r for r in s.cut(docs, length=length).collect()}
        got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in (rows[x.doc_id] for x in docs.collect())]
        assert got == brute(texts, length)


def test_repeated_rows_and_empty_table(corpus):
    docs = corpus("abc" * 100, "abc" * 100, "short", ids=[1, 1, 2])
    assert sorted((r.doc_id, r.n_removed) for r in s.cut(docs).collect()) == [(1, 300), (1, 300), (2, 0)]
    assert s.cut(docs.limit(0)).count() == 0
