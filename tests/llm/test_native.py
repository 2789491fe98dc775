"""Quality rules, surrogates and shards."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpus_fixtures import corpus, labels  # noqa: F401
from emberline.llm import pii, quality_rules, sharding


def plain_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    triples = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if triples[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures(corpus):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "bb", "é", "🙂", " ", "  ", "\n", "\t", "\x0b", "#", "\xa0"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "a", "a b", "a b c", "a a a a a"]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r.doc_id: tuple(r[n] for n in names) for r in quality_rules.measures(corpus(*texts)).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(texts)}


def test_binomial_bound_is_exact():
    for n, p in ((30, 0.1), (400, 0.02)):
        for k in range(0, int(n * p)):
            want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
            assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9)
    assert quality_rules.accepted(10**9, 0, 0.02, 1e-6) and not quality_rules.accepted(10**9, 2 * 10**7 - 1, 0.02, 1e-3)


def test_chosen_cutoffs_remove_few_good_documents(corpus, labels):
    good = [" ".join(f"word{i}x{j}" for j in range(60)) for i in range(600)]
    noisy = [" ".join(f"word{i}x{j}###" for j in range(60)) for i in range(50)]
    docs = corpus(*good, *noisy, None, "short text").withColumn("lang", F.lit("en"))
    marks = labels(*[(i, 1, 0) for i in range(600)], (0, None, 0), *[(i, 0, 0) for i in range(600, 650)])
    out = {r.doc_id: r for r in quality_rules.judge(docs, marks).collect()}
    assert all(out[i].kept for i in range(600))
    assert all("symbols" in out[i].removed_by and not out[i].kept for i in range(600, 650))
    assert not out[650].kept and not out[651].kept
    kept = quality_rules.keep_good(docs, marks)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == list(range(600))
    few = quality_rules.judge(docs, marks.limit(20))
    assert few.where("kept").count() == 650  # too few labels for any guarantee
    assert quality_rules.judge(docs.limit(0), marks).count() == 0


ENTITIES = {
    "email": ["a.b@corp.co.uk", "zoë@mail3.example.com", "x1@y.org"],
    "phone": ["+1 (499) 555-6503", "+1 (499) 444-6503", "(212) 555-0199", "212-444-1234", "+49 30 1234567"],
    "ip": ["10.0.0.255", "255.1.2.3"],
    "card": ["4111111111111111", "4111 1111 1111 1112", "378282246310005"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "ssn": ["123-45-6789"],
    "secret": ["1eb9c654e721b4f812088970e66a6345cee33dd6", "1EB9C654E721B4F812088970E66A6345CEE33DD6"],
}


def form(x):
    return re.sub("[0-9]", "9", re.sub(r"[^\W\d_]", "a", x))


def test_types_and_formats(corpus):
    every = [(k, e) for k, es in ENTITIES.items() for e in es]
    found = {r.entity: r for r in pii.entities(corpus(*[f"see {e}, again {e}." for _, e in every])).collect()}
    assert {e: found[e].kind for _, e in every} == {e: k for k, e in every}
    for kind, e in every:
        s = found[e].surrogate
        assert s != e
        if kind == "ip":
            assert all(0 <= int(o) < 256 for o in s.split("."))
        elif kind != "secret":
            assert form(s) == form(e), (e, s)
        else:
            assert len(s) == len(e) and (s.islower() or s.isupper())

    def luhn(x):
        d = [int(c) for c in re.sub(r"\D", "", x)][::-1]
        return sum(d[::2] + [v * 2 - 9 * (v > 4) for v in d[1::2]]) % 10

    assert all(luhn(found[e].surrogate) == luhn(e) for e in ENTITIES["card"])
    assert re.sub(r"\D", "", found["+1 (499) 555-6503"].surrogate)[4:7] == "555"


def test_persons_keep_gender_script_and_identity(corpus):
    text = (
        "Dr. Anna Weber met Frau Anna Weber. Anna Weber wrote; Weber agreed, Weberin not. Herr Karl Maria Huber and Mrs. Ana-Lia O'Brien McDonald left, "
        "Karl Maria Huber too. Prof. Ludwig van Dam, Mr. J. Smith, Mr. John F. Kennedy. Herr Петров, Петров."
    )
    out = pii.pseudonymise(corpus(text, "Anna Weber and John Smith called.", "Frau Weber")).orderBy("doc_id").collect()
    n = r"([\w'-]+)"
    pattern = (
        rf"Dr\. {n} {n} met Frau {n} {n}\. {n} {n} wrote; {n} agreed, Weberin not\. Herr {n} {n} {n} and Mrs\. {n} {n} {n} left, {n} {n} {n} too\. "
        rf"Prof\. {n} van {n}, Mr\. J\. {n}, Mr\. {n} F\. {n}\. Herr {n}, {n}\."
    )
    m = re.fullmatch(pattern, out[0].text)
    assert m, out[0].text
    assert m[1] == m[3] == m[5] and m[2] == m[4] == m[6] == m[7]  # one person, with any form of address and without
    assert m.group(8, 9, 10) == m.group(14, 15, 16)
    assert [x[-1] for x in m.group(1, 2, 8, 11)] == ["a", "r", "l", "a"] and m[22] == m[23] and re.fullmatch("[А-ЯЁЅІЇЄ][а-яёѕіїє]+", m[22])
    for gone in ("Anna", "Karl", "Maria", "Huber", "Brien", "Donald", "Ludwig", "Dam", "Smith", "Kennedy", "Петров"):
        assert gone not in out[0].text, gone
    assert out[1].text == "Anna Weber and John Smith called."  # nobody is introduced there
    assert out[2].text == f"Frau {m[2]}"


def test_the_key_is_the_sessions_or_a_random_one(spark, corpus):
    docs = corpus("Frau Anna Weber, a.b@corp.org")
    text = lambda **k: pii.pseudonymise(docs, **k).first().text
    assert text(key="one") == text(key="one") != text(key="two")
    assert pii.configured_key(spark) != pii.configured_key(spark)
    spark.conf.set(pii.KEY_SETTING, "one")
    try:
        assert text() == text(key="one")
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_long_texts_with_many_persons_and_odd_column_names(corpus):
    names = [f"{a}{b}" for a in ("Ba", "Ce", "Di", "Fo", "Gu") for b in ("ler", "mann", "ston", "vic", "berg")]
    body = " ".join(f"Frau {x} {y} spoke. Later {x} {y} and {y} went." for x in names for y in names)
    docs = corpus(body, None, "").withColumn("a.b", F.lit(1)).withColumn("_gaps", F.lit(2)).withColumn("_names", F.lit(3))
    out = pii.checked(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert not any(re.search(rf"\b{x}\b", rows[0].text) for x in names)
    assert re.sub(r"\w", "x", rows[0].text) == re.sub(r"\w", "x", body) and rows[0]["_names"] == 3 and rows[1].text is None and rows[2].text == ""
    pairs = re.findall(r"Frau (\w+ \w+) spoke\. Later (\w+ \w+) and", rows[0].text)
    assert len({a for a, _ in pairs}) == 625 and all(a == b for a, b in pairs)


def test_addresses_after_punctuation_and_national_phones(corpus):
    phones = ["212 555 0147", "1-800-555-0199", "1 (800) 555-0199", "030 1234567", "0171/5550123", "0171 555 01 23", "(030) 1234567", "01 23 45 67 89"]
    mails = ["_anna.b@firma.de_", "-anna@firma.de", ".anna@firma.de", "*anna@firma.de*"]
    docs = corpus(*[f"call {p}, or {p}." for p in phones], *[f"see {m} now" for m in mails])
    found = pii.entities(docs).collect()
    assert [(r.kind, r.entity) for r in sorted(found, key=lambda r: r.doc_id)] == [
        *(("phone", p) for p in phones for _ in "ab"), *(("email", m.strip("_-.*")) for m in mails)
    ]
    assert all(form(r.surrogate) == form(r.entity) and r.surrogate != r.entity for r in found)
    assert {r.surrogate[0] for r in found if r.entity[0] == "1"} == {"1"}
    dates = "on 01.02.2003, 01/02/2003, 01-02-2003, 2020-01-02, 05/2020, 1 000 000 1234, 0.12345678, 01.12345678"
    assert pii.entities(corpus(dates)).count() == 0
    ssn = {r.entity: r.kind for r in pii.entities(corpus("012-34-5678, 0123 4567 8901 2345")).collect()}
    assert ssn == {"012-34-5678": "ssn", "0123 4567 8901 2345": "card"}


def test_secrets_keep_their_name(corpus):
    out = pii.pseudonymise(corpus('password: hunter2hunter2 token = "abcdefgh"')).first().text
    assert out.startswith("password: ") and 'token = "' in out and "hunter2" not in out and "abcdefgh" not in out


def test_surrogates_are_one_to_one(spark, corpus):
    rng = random.Random(6)
    values = {f"+1 ({rng.randint(200, 299)}) {rng.choice(['555', '444'])}-{rng.randint(1000, 1040)}" for _ in range(1500)}
    values |= {f"{rng.choice('ab')}{rng.choice('cd')}.{rng.randint(0, 99):02d}@mail{rng.randint(1, 3)}.example.com" for _ in range(500)}
    values |= {f"{rng.randint(1, 3)}.{rng.randint(0, 9)}.0.{rng.randint(0, 255)}" for _ in range(500)}
    found = pii.entities(corpus(*(f"x {v} y {v}" for v in sorted(values)))).collect()
    surrogates = {}
    for r in found:
        surrogates.setdefault(r.entity, set()).add(r.surrogate)
    assert set(surrogates) == values and all(len(x) == 1 for x in surrogates.values())
    assert len({min(x) for x in surrogates.values()}) == len(values)


def test_texts_without_entities_and_edge_rows(corpus):
    docs = corpus(None, "", "nothing here, 12 of 34", "a@b", ids=[1, 1, None, 3])
    out = pii.checked(docs)
    assert out.schema == docs.schema and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert pii.checked(docs.limit(0)).count() == 0


def test_shards_are_even_and_gapless(corpus):
    rng = random.Random(7)
    docs = corpus(*["x" * rng.randint(0, 300) for _ in range(2000)], None, None, ids=[*range(1998), 5, 5, None, None])
    rows = sharding.shard(docs, 8).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    assert len(rows) == 2002 and set(size) == set(range(8)) and max(size.values()) - min(size.values()) < 700
    for s in range(8):
        numbers = sorted(r.number for r in rows if r.shard == s)
        assert numbers == list(range(len(numbers)))
    assert sharding.shard(docs.limit(0), 8).count() == 0


def test_map_edits_move_little(spark, tmp_path):
    weights = spark.createDataFrame([(i, (i * 7919) % 100) for i in range(64)], "slot int, bytes long")
    first = sharding.edit_map(weights, 4)
    sharding.save_map(first, str(tmp_path / "map"))
    again = sharding.edit_map(weights, 4, sharding.load_map(spark, str(tmp_path / "map")))
    grown = sharding.edit_map(weights, 5, sharding.load_map(spark, str(tmp_path / "map")))
    sharding.save_map(grown, str(tmp_path / "map"))
    shard_of = lambda m: {r.slot: r.shard for r in m.collect()}
    old, new = shard_of(first), shard_of(grown)
    assert len(old) == len(new) == 64
    assert sum(old[s] != v for s, v in shard_of(again).items()) <= 8
    assert sum(old[s] != new[s] for s in old) <= 32 and set(new.values()) == set(range(5))
    assert shard_of(sharding.load_map(spark, str(tmp_path / "map"), 1)) == old
    assert sharding.load_map(spark, str(tmp_path / "map")).first().version == 2
