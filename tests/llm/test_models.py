"""Toxicity and perplexity."""

import gc
import math
import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_fixtures import corpus, labels  # noqa: F401
from emberline.llm import kneser_ney, toxicity
from emberline.operators.lineage import checkpoint_root

SYLLABLES = ["ba", "lo", "mi", "ter", "san", "que", "ri", "no", "da", "vel"]
BAD = ["worthless", "pathetic", "disgusting", "moron"]


def prose(rng, n, bad=0):
    w = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for _ in range(bad):
        w.insert(rng.randrange(len(w)), rng.choice(BAD))
    return " ".join(w)


def test_held_out_accuracy(corpus, labels):
    rng = random.Random(3)
    marks = [int(rng.random() < 0.3) for _ in range(600)]
    docs = corpus(*[prose(rng, 80, 4 * m) for m in marks], None, "", "short", ids=[*range(600), 600, 601, None])
    out = toxicity.score(docs, labels(*[(i, None, m) for i, m in enumerate(marks)], (7, 1, None), (None, 1, 1)))
    rows = {r.doc_id: r.score for r in out.collect()}
    assert len(rows) == 603 and all(0 <= s <= 1 for s in rows.values())
    held = [r.doc_id for r in out.where(toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT).collect() if r.doc_id is not None and r.doc_id < 600]
    assert np.mean([(rows[i] >= 0.3) == marks[i] for i in held]) > 0.9
    assert rows[600] == rows[601] < 0.3 and rows[None] < 0.3


def test_without_labels_or_documents(corpus, labels):
    docs = corpus("a b c", None)
    assert [r.score for r in toxicity.score(docs, labels((0, 1, 0)).limit(0)).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), labels((0, 1, 0))).count() == 0


def test_only_near_copies_are_dropped_from_the_training_texts():
    rng = random.Random(8)
    opening = ["once", "upon", "a", "time"]
    texts = [[x.encode() for x in [*opening, *prose(rng, 20).split()]] for _ in range(60)]
    assert toxicity.unlike(texts) == [*range(60)]
    copies = [t[:-1] + [b"changed"] for t in texts[:10]]
    assert toxicity.unlike(texts + copies) == [*range(60)]


def test_a_text_too_long_for_the_sample_does_not_end_it(corpus):
    for long in range(6):
        texts = ["word " * (1000 if i == long else 2) for i in range(6)]
        got = toxicity.sample_texts(corpus(*texts), [*range(6)], 100)
        assert sorted(got) == ["word word "] * 5


def test_the_fit_does_not_depend_on_partitions_or_repeated_rows(corpus, labels):
    rng = random.Random(4)
    marks = [int(rng.random() < 0.4) for _ in range(120)]
    docs = corpus(*[prose(rng, 40, 3 * m) for m in marks])
    known = labels(*[(i, None, m) for i, m in enumerate(marks)])
    want = {r.doc_id: r.score for r in toxicity.score(docs.coalesce(1), known).collect()}
    copies = docs.union(docs.where("doc_id % 7 = 0")).union(docs.where("doc_id % 7 = 0")).repartition(5, F.rand(1))
    got = toxicity.score(copies, known).select("doc_id", "score").collect()
    assert len(got) > 150 and all(r.score == want[r.doc_id] for r in got)
    ids = list(range(0, 120, 3))
    assert toxicity.sample_texts(copies, ids, 10_000) == toxicity.sample_texts(docs.coalesce(1), ids, 10_000)


def plain_perplexities(train, docs):
    """Interpolated modified Kneser-Ney of word pairs from dictionaries, all words known; perplexity of each text of ``docs``."""
    split = kneser_ney.split_words
    pairs = Counter(p for t in train for p in zip(["<s>", *split(t)], split(t)))
    types = Counter(b for _, b in pairs)
    words = {w for t in train for w in split(t)}

    def discounts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[1] and n[2] else 0.5 * min(k, 2) for k in (1, 2, 3)]
        return [0.0] + [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), raw)]

    d1, d2, n_types = discounts(types), discounts(pairs), len(pairs)
    left = sum(d1[min(c, 3)] for c in types.values()) / n_types
    followed = defaultdict(dict)
    for (a, b), c in pairs.items():
        followed[a][b] = c

    def p(a, b):
        one = (max(types[b] - d1[min(types[b], 3)], 0) / n_types if b in words else 0) + left / (len(words) + 1)
        own = followed.get(a)
        if not own:
            return one
        total = sum(own.values())
        c = own.get(b, 0)
        return max(c - d2[min(c, 3)], 0) / total + sum(d2[min(x, 3)] for x in own.values()) / total * one

    out = []
    for t in docs:
        w = split(t)
        known = [x if x in words else "<unknown>" for x in w]
        bits = sum(math.log2(p(a, b)) for a, b in zip(["<s>", *known], known))
        out.append(2 ** (-bits / len(w)) if w else None)
    return out


@pytest.mark.parametrize("frequent", [0, 200, 1 << 18])
def test_perplexities_against_dictionaries(spark, frequent):
    rng = random.Random(5)
    train = [prose(rng, 30) for _ in range(60)] + ["the cat. The cat sat, 12 times!"] * 7
    docs = train[::9] + [prose(rng, 40) for _ in range(20)] + ["the cat sat on zzz qqq the", "", None, "  \n", "这是 the cat"] + train[:1] * 30
    frame = lambda texts: spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "_id long, _lang int, _text string")
    fitted, pairs = kneser_ney.fit(frame(train), 1)
    got = {r._id: r for r in kneser_ney.log_probabilities(frame(docs), fitted, pairs, frequent).collect()}
    for i, want in enumerate(plain_perplexities(train, docs)):
        value = None if got[i].bits is None else 2 ** (-got[i].bits / got[i].n_words)
        assert value == (want and pytest.approx(want, rel=1e-6)), docs[i]


@pytest.mark.parametrize("bounds", [{"FLUSH": 300, "BUCKET_PAIRS": 7}, {"TEXT_BITS": 7, "COUNT_BUCKETS": 1, "ASK_BUCKETS": 1}])
def test_perplexities_do_not_depend_on_batches_and_buckets(spark, monkeypatch, bounds):
    rng = random.Random(5)
    train = [prose(rng, 30) for _ in range(60)] + ["the cat sat"] * 7
    docs = [x for i in range(20) for x in (train[i], prose(rng, 40), "", None, "the cat sat on zzz qqq the", train[0])] + ["the cat sat"] * 100
    frame = lambda texts: spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "_id long, _lang int, _text string").coalesce(2)
    for k, v in bounds.items():
        monkeypatch.setattr(kneser_ney, k, v)
    fitted, pairs = kneser_ney.fit(frame(train), 2)
    got = {r._id: r for r in kneser_ney.log_probabilities(frame(docs), fitted, pairs, 50).collect()}
    assert len(got) == len(docs)
    for lang in (0, 1):
        # Each language has its own model, of the words it has.
        for i, want in zip(range(lang, len(docs), 2), plain_perplexities(train[lang::2], docs[lang::2])):
            value = None if got[i].bits is None else 2 ** (-got[i].bits / got[i].n_words)
            assert value == (want and pytest.approx(want, rel=1e-6)), docs[i]
            assert (got[i]._lang, got[i].chars, got[i].n_words) == (lang, len(docs[i] or ""), len(kneser_ney.split_words(docs[i])))


def test_packed_numbers():
    rng = np.random.default_rng(2)
    for numbers in (np.zeros(0, np.int64), np.zeros(3, np.int64), np.array([255, 256, 0]), np.array([(1 << 62) + 1, 5]), rng.integers(0, 1 << 40, 1000)):
        assert kneser_ney.unpacked(kneser_ney.packed(numbers), len(numbers)).tolist() == numbers.tolist()
        ascending = np.sort(numbers)
        assert kneser_ney.unpacked_pairs(kneser_ney.packed_pairs(ascending), len(numbers)).tolist() == ascending.tolist()


def test_disk_of_a_pair(spark):
    """All that is written and dealt while texts are scored takes few bytes for each of their pairs."""
    rng = random.Random(11)
    words = ["".join(rng.choice(SYLLABLES) for _ in range(5)) for _ in range(5000)]
    texts = [(i, 0, " ".join(rng.choices(words, k=600))) for i in range(1000)]
    docs = spark.createDataFrame(texts, "_id long, _lang int, _text string").coalesce(2)
    fitted, pairs = kneser_ney.fit(docs, 1)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)  # so that files of earlier tests do not go meanwhile
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with larger tables
    before = disk(spark)
    try:
        kneser_ney.log_probabilities(docs, fitted, pairs, 0).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert disk(spark) - before < 20 * 600 * 1000  # most of it for the filter, which has a fixed size


def disk(spark):
    """Bytes of shuffle files and of written tables."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    shuffles = sum(blocks.apply(i).length() for i in range(blocks.size()))
    return shuffles + sum(p.stat().st_size for p in Path(checkpoint_root(spark).removeprefix("file:")).rglob("*") if p.is_file())


def test_probabilities_add_up(spark):
    rng = random.Random(7)
    train = [prose(rng, 40) for _ in range(40)]
    texts = spark.createDataFrame([(0, t) for t in train], "_lang int, _text string")
    for size in (1 << 18, 60):  # with a small vocabulary most words are one class
        fitted, pairs = kneser_ney.fit(texts, 1, size)
        table = kneser_ney.gain_table(pairs, fitted)
        rows = {(r.pair >> kneser_ney.BITS, r.pair & ((1 << kneser_ney.BITS) - 1)): r.gain for r in table.collect()}
        n = len(fitted.vocabulary)
        words = [0, *range(2, n)]  # 1 is the start of a text
        assert len(fitted.vocabulary.keys) <= size
        for a in (0, 1, 2, n - 1):
            every = [fitted.p1[b] * 2 ** (fitted.rest[a] + rows.get((a, b), 0.0)) for b in words]
            assert sum(every) == pytest.approx(1)


def test_scripts_and_strata(corpus, labels):
    """Prose differs from noise in scripts other than Latin too, and each language has its own limit."""
    rng = random.Random(9)
    alphabets = {"ru": "абвгдежзиклмнопрст", "el": "αβγδεζηθικλμνξοπρσ"}
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(150)] for k, a in alphabets.items()}
    text = {k: [" ".join(rng.choice(w) for _ in range(50)) for _ in range(420)] for k, w in words.items()}
    noise = {k: [" ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(50)) for _ in range(20)] for k, a in alphabets.items()}
    docs = corpus(*text["ru"], *text["el"], *noise["ru"], *noise["el"], "unseen language here")
    docs = docs.withColumn("lang", F.expr("CASE WHEN doc_id < 420 THEN 'ru' WHEN doc_id < 840 THEN 'el' WHEN doc_id < 860 THEN 'ru' WHEN doc_id < 880 THEN 'el' END"))
    out = {r.doc_id: r for r in kneser_ney.score(docs, labels(*[(i, 1, 0) for i in range(840)])).collect()}
    for own, bad in ((range(420), range(840, 860)), (range(420, 840), range(860, 880))):
        assert max(out[i].perplexity for i in own) * 5 < min(out[i].perplexity for i in bad)
        assert np.mean([out[i].kept for i in own]) > 0.97 and not any(out[i].kept for i in bad)
    assert not {out[i].threshold for i in range(420)} & {out[i].threshold for i in range(420, 840)}
    assert out[880].perplexity is None and out[880].kept  # no trusted text in its language: nothing to judge by


def test_edge_rows_of_the_language_model(corpus, labels):
    docs = corpus("a b c", None, "", "word " * 50_000, "a b c", ids=[0, 1, None, 3, 3]).withColumn("extra.column", F.lit(1)).withColumn("bits", F.lit("x"))
    out = kneser_ney.score(docs, labels((0, 1, 0), (0, None, 0), (3, 1, 0))).collect()
    assert len(out) == 5 and sum(r.kept for r in out) == 3
    assert all(r.perplexity is None for r in out if r.doc_id in (1, None))
    assert len(kneser_ney.score(docs, labels((0, 1, 0)).limit(0)).collect()) == 5
    assert kneser_ney.score(docs.limit(0), labels((0, 1, 0))).count() == 0


def test_junk_is_rejected_and_prose_kept(corpus, labels):
    rng = random.Random(6)
    docs = corpus(*[prose(rng, 60) for _ in range(400)], *["%$#@! zxqj wvkx 98 {}" * 10 for _ in range(20)], None, "")
    docs = docs.withColumn("lang", F.lit("en"))
    out = {r.doc_id: r for r in kneser_ney.score(docs, labels(*[(i, 1, 0) for i in range(300)], (0, None, 0))).collect()}
    assert len(out) == 422
    assert np.mean([out[i].kept for i in range(400)]) > 0.97
    assert not any(out[i].kept for i in range(400, 422))
    assert out[420].perplexity is None and out[421].perplexity is None
    assert kneser_ney.score(docs.limit(0), labels((0, 1, 0))).count() == 0
