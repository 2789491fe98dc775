import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_fixtures import corpus  # noqa: F401
from emberline.llm import decontaminate as d


def brute(texts, items, window=10):
    windows = {}
    for name, text in items:
        w = d.split_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(name)
    out = []
    for t in texts:
        w = d.split_words(t)
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((len(w), len(hit), sorted(names)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", max_size=300), max_size=5), st.lists(st.text("ab c", max_size=80), max_size=5))
def test_index_against_brute_force(texts, items):
    items = [(str(i), t) for i, t in enumerate(items)]
    phrases = d.Phrases(items)
    numbers = [np.array([phrases.vocabulary.get(w, 0) for w in d.split_words(t)], np.int64) for t in texts]
    doc, item, hit = d.search_shard(numbers, phrases)
    at, got = 0, []
    for i, w in enumerate(numbers):
        got.append((len(w), int(hit[at : at + len(w)].sum()), sorted(phrases.names[j] for j in item[doc == i])))
        at += len(w) + 1
    assert got == brute(texts, items)


def test_find_and_remove_in_blocks(spark, corpus, monkeypatch):
    rng = random.Random(1)
    word = lambda: rng.choice(["Alpha", "beta", "gamma", "delta", "eps", "zeta"])
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 25)))) for i in range(12)] + [(3, "one two"), (None, "three four"), (99, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"start {items[i % 12][1]} rest-of, it ONE  two" for i in range(20)] + [None, "", "three, four", "nothing at all"]
    docs = corpus(*texts)
    want = brute(texts, [("" if i is None else str(i), t) for i, t in items])
    for block in (1_000_000, 40):
        monkeypatch.setattr(d, "BLOCK_WORDS", block)
        rows = {r.doc_id: r for r in d.find(docs, bench).collect()}
        got = [(rows[i].n_words, sum(s.end - s.start for s in rows[i].spans), list(rows[i]["items"])) for i in range(len(texts))]
        assert got == want
        kept = d.remove(docs, bench)
        assert kept.schema == docs.schema
        assert {r.doc_id for r in kept.collect()} == {i for i, (n, h, _) in enumerate(want) if not h or h < n}
        assert all(h == 0 for _, h, _ in brute([r.text for r in kept.collect()], [(str(i), t) for i, t in items]))
    assert d.find(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert d.find(docs.limit(0), bench).count() == 0
