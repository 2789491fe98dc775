"""Repeated lines against all pairs, passages against planted ones."""

import random
import re

import pytest
from corpus_fixtures import corpus  # noqa: F401
from emberline.llm import paragraphs
from pyspark.sql import functions as F

SYLLABLES = "ka lo mi ren sto bu dra fel gin hop jat kru lis".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(2, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def counted_lines(docs):
    """(row, doc_id, number, words) of the lines that count."""
    for row, r in enumerate(docs):
        for number, line in enumerate((r.text or "").split("\n")):
            words = re.sub(r"[\W_]+", " ", line.lower()).split()
            if len(words) >= 8:
                yield row, r.doc_id, number, words


def labels(n, pairs):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        label[root(a)] = root(b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("big", [False, True])
def test_lines_against_all_pairs(corpus, big, request):
    if big:
        request.getfixturevalue("forced_big")
    rng = random.Random(9)
    lines = [prose(rng, 40) for _ in range(30)]
    edited = [" ".join([*line.split()[:-1], "changed"]) for line in lines[:10]]
    texts = ["\n".join(rng.sample(lines + edited, 3) + [prose(rng, 30), "too short"]) for _ in range(40)]
    docs = corpus(*texts, None, "", texts[0], ids=[*range(40), 40, 41, 0])
    seen = list(counted_lines(docs.collect()))
    sets = [set(zip(*(w[i:] for i in range(5)))) for *_, w in seen]
    similar = [(i, j) for i in range(len(seen)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    groups = {}
    for place, label in zip(seen, labels(len(seen), similar)):
        groups.setdefault(label, []).append(place)
    want = sorted(p[1:3] for g in groups.values() for p in sorted(g, key=lambda p: (p[1], p[2], p[0]))[1:])
    got = paragraphs.removals(docs).collect()
    assert sorted((r.doc_id, r.paragraph) for r in got if r.paragraph is not None) == want
    assert all(r.length > 0 and len(texts[r.doc_id][r.start : r.start + r.length].split()) >= 8 for r in got)
    assert paragraphs.removals(docs.limit(0)).count() == 0


def planted(rng, n_docs, n_passages, size, edit=0.0):
    """Texts of unrelated words with shared passages inside, each in other surroundings and line breaks."""
    shared = [[word(rng) for _ in range(size)] for _ in range(n_passages)]
    texts, marks = [], []
    for _ in range(n_docs):
        words, mark = [], []
        for _ in range(rng.randrange(1, 4)):
            filler = [f"{word(rng)}{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 120))]
            words, mark = words + filler, mark + [None] * len(filler)
            if rng.random() < 0.7:
                k = rng.randrange(n_passages)
                passage = [w if rng.random() >= edit else w + "x" for w in shared[k]]
                words, mark = words + passage, mark + [k] * size
        breaks = [rng.choice([" ", " ", " ", " ", "\n", ", "]) for _ in words]
        texts.append("".join(w + b for w, b in zip(words, breaks)))
        marks.append((words, mark))
    return texts, marks


def removed_words(texts, rows):
    """For each text, is its n-th word removed?"""
    out = []
    for i, text in enumerate(texts):
        spans = [(r.start, r.start + r.length) for r in rows if r.doc_id == i]
        out.append([any(a <= m.start() and m.end() <= b for a, b in spans) for m in re.finditer(r"\w+", text)])
    return out


@pytest.mark.parametrize("size, edit, recall", [(55, 0.0, 0.95), (120, 0.0, 0.97), (200, 0.01, 0.85)])
def test_recall_of_passages_inside_other_text(corpus, size, edit, recall):
    rng = random.Random(size)
    texts, marks = planted(rng, 120, 12, size, edit)
    gone = removed_words(texts, paragraphs.removals(corpus(*texts)).collect())
    first, hit, total, wrong, clean = set(), 0, 0, 0, 0
    for (_, mark), removed in zip(marks, gone):
        assert len(mark) == len(removed)
        at = 0
        while at < len(mark):
            if mark[at] is None:
                clean, wrong, at = clean + 1, wrong + removed[at], at + 1
                continue
            if mark[at] in first:
                hit, total = hit + sum(removed[at : at + size]), total + size
            else:
                assert edit or not any(removed[at : at + size])
            first.add(mark[at])
            at += size
    assert total > 40 * size and hit >= recall * total
    assert wrong <= 0.001 * clean


def test_short_repeats_are_no_passages(corpus):
    rng = random.Random(4)
    shared = [prose(rng, 20) for _ in range(5)]
    texts = [" ".join(f"{prose(rng, 30)} {rng.choice(shared)} {prose(rng, 30)}" for _ in range(3)) for _ in range(60)]
    assert paragraphs.removals(corpus(*texts)).collect() == []


def test_passages_over_line_breaks_and_case(corpus):
    rng = random.Random(12)
    words = [word(rng) for _ in range(60)]
    filler = [prose(rng, 240) for _ in range(4)]
    wrapped = "\n".join(" ".join(words[i : i + 6]) for i in range(0, 60, 6)).upper()
    texts = [f"{filler[0]} {' '.join(words)} {filler[1]}", f"{filler[2]}\n{wrapped}\n{filler[3]}", None]
    (r,) = paragraphs.removals(corpus(*texts, ids=[1, 0, 2])).collect()
    assert (r.doc_id, r.paragraph, r.kept_doc_id, r.members) == (1, None, 0, 2)
    assert texts[0][r.start : r.start + r.length] == " ".join(words)


def test_scripts_without_spaces(corpus):
    rng = random.Random(13)
    text = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    shared = text(80)
    texts = [text(90) + shared + text(50), text(70) + shared + "。" + text(60)]
    (r,) = paragraphs.removals(corpus(*texts)).collect()
    assert r.doc_id == 1 and texts[1][r.start : r.start + r.length] == shared


def test_texts_are_cut_one_by_one():
    rng = random.Random(2)
    texts = [prose(rng, 50), None, "", "one\ntwo", prose(rng, 70) + "\n" + prose(rng, 9)]

    def cut(some):
        w = paragraphs.words_of(some)
        if w is None:
            return []
        a, n, seq, node = paragraphs._segments(w)
        own = w.text[a]
        return list(zip(own.tolist(), (w.first[a] - w.begin[own]).tolist(), n.tolist(), seq.tolist(), node.tolist()))

    assert cut(texts) == [(i, *x[1:]) for i, t in enumerate(texts) for x in cut([t])]
    assert sum(n for i, _, n, *_ in cut(texts) if i == 4) == 79


def test_lines_that_differ_in_numbers_stay(corpus):
    line = "on {} the station at height {} saw {} fires of {} hectares and {} alarms"
    numbers = " ".join(map(str, range(100, 130)))
    docs = corpus(line.format(1, 20, 31, 47, 5), line.format(2, 21, 38, 44, 9), line.format(1, 20, 31, 47, 5), numbers, numbers)
    assert sorted((r.doc_id, r.paragraph) for r in paragraphs.removals(docs).collect()) == [(2, 0), (4, 0)]


def test_long_text_columns_of_any_name_and_null_ids(spark):
    rng = random.Random(6)
    long = prose(rng, 60_000)
    rows = [(None, long, 1, "b", 5), (7, long, 1, "b", 5), (7, long, 1, "b", 5), (8, None, 1, "b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, identity string, _ int")
    got = paragraphs.removals(df).collect()
    assert sorted((r.doc_id or -1, r.paragraph) for r in got) == [(-1, 0), (7, 0)]
    assert {r.kept_doc_id for r in got} == {7} and {r.members for r in got} == {3}


def test_words_beyond_a_segment_only_where_asked(corpus):
    rng = random.Random(21)
    shared = prose(rng, 60)
    narrow = paragraphs._narrow(corpus(" ".join([prose(rng, 50), shared, prose(rng, 50), shared, prose(rng, 50)]), prose(rng, 90)), "doc_id", "text")
    segments = paragraphs.occurrences(narrow).where("paragraph IS NULL").select("_key", "start", "identity")
    twice = segments.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.min("_key").alias("_key")).where("n > 1")
    one, other = twice.orderBy("start").limit(2).collect()
    rows = [(one._key, one.start, one.identity, True), (other._key, other.start, other.identity, False)]
    edges = narrow.sparkSession.createDataFrame(rows, "_key long, start long, identity long, _after boolean")
    first, second = sorted(paragraphs._contexts(narrow, edges).collect(), key=lambda r: r.start)
    assert (first.start, second.start) == (one.start, other.start)
    assert first.before is None and len(first.after) == len(first.after_at) == paragraphs.REACH
    assert second.after is None and len(second.before) == len(second.before_at) == paragraphs.REACH


def test_band_recall_at_the_threshold():
    assert 1 - (1 - paragraphs.SIMILARITY**paragraphs.BAND_ROWS) ** paragraphs.BANDS > 0.99
