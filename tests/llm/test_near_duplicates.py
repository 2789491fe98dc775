import random

import numpy as np
from pyspark.sql import functions as F

from corpus_fixtures import corpus  # noqa: F401
from emberline.llm import links, simhash

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def components(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(i) for i in range(n)]


def test_general_pigeonhole_plans_meet_every_near_pair():
    rng = np.random.default_rng(2)
    bits = rng.random((500, 64)) < rng.random(64)
    both = (bits.T.astype(float) @ bits).astype(float)
    for n in (500, 10**7, 10**10):
        parts = simhash.plan(n, both * (n / 500))
        looks = simhash.masks(parts)
        for _ in range(300):
            flipped = rng.choice(64, rng.integers(0, 4), replace=False)
            difference = np.uint64(sum(1 << int(b) for b in flipped))
            assert ((looks & difference) == 0).any(), (parts, flipped)


def test_groups_against_brute_force(corpus):
    rng = random.Random(4)
    base = [prose(rng, 60) for _ in range(60)]
    near = [b.replace(" ", "  ", 1) if i % 3 else b + " " + rng.choice(WORDS) for i, b in enumerate(base[:40])]
    docs = corpus(*base, *near, *[base[0].upper()] * 30, None, "", " \n ")
    rows = simhash.near_duplicates(docs).collect()
    texts = [r.text for r in sorted(docs.collect())]
    prints = [int.from_bytes(simhash.fingerprint(t), "big") for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = components(len(texts), pairs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in range(len(texts))}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_keep_one_of_repeated_rows_and_null_ids(corpus):
    docs = corpus("a b c d", "a b c d", "a b c d", "x y z", ids=[1, 1, None, None])
    assert sorted((r.doc_id or -1, r.text) for r in simhash.keep_one(docs).collect()) == [(-1, "x y z"), (1, "a b c d")]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_large_groups_are_cut_into_blocks(spark):
    def near(values, some, others):
        v = values.to_numpy()
        return np.abs(v[some][:, None] - v[others]) <= 1

    values = [*range(0, 60), *range(100, 130), 500]
    keyed = spark.createDataFrame([(7, v, v) for v in values] + [(8, 900, 900), (8, 901, 901)], "key long, node long, value long")
    for limit in (4, 16, 1000):
        found = links.roots(spark, links.links(keyed.repartition(3), near, limit))
        groups = found.groupBy("root").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).collect()
        assert sorted((g.a, g.b, g.n) for g in groups) == [(0, 59, 60), (100, 129, 30), (900, 901, 2)]
