import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpus_fixtures import corpus  # noqa: F401
from emberline.llm import packing
from emberline.llm.queries import tokenizer

ALPHABET = ["a", "B", "é", "İ", "Σ", ".", ",", "...", "  ", "\n", "\x1c", "\xa0", "<|endoftext|>", "'s", "1", "́", "ß", "漢", "abc", "The", "!!"]


def test_ids_equal_the_tokenizers_own():
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))) for _ in range(2000)] + [None, "", "x" * 500]
    plain, encoder = Tokenizer.from_str(tokenizer()), packing.Encoder(tokenizer())
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_plan_uses_every_piece_once_and_wastes_little():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 2049, 3000), minlength=2049)
    used, sequences = np.zeros(2049, int), 0
    for pattern, times in packing.plan(counts):
        assert sum(pattern) <= 2048
        np.add.at(used, pattern, times)
        sequences += times
    assert (used == counts).all()
    lower = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert sequences <= lower * 1.01 + 1


def test_exact_complements_of_one_two_and_three():
    for lengths in ([6, 4], [5, 3, 2], [4, 3, 2, 1]):
        assert packing.plan(np.bincount(lengths, minlength=11)) == [(sorted(lengths, reverse=True), 1)]


def test_pack_is_gapless(spark, corpus):
    rng = random.Random(5)
    docs = corpus(*[" ".join(["word"] * rng.randint(0, 40)) for _ in range(200)], None, "", ids=[*range(100), *range(100), None, None])
    out = packing.pack_documents(docs, tokenizer(), limit=16).collect()
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()]
        assert sum(n for _, n in places) <= 16
    assert sum(r.length for r in out) == sum(len((r.text or "").split()) + 1 for r in docs.collect())
    empty = [r for r in out if r.doc_id is None]
    assert [(r.length, r.ids_crc32) for r in empty] == [(1, zlib.crc32(bytes(4)))] * 2


def test_empty_table(corpus):
    assert packing.pack_documents(corpus("a").limit(0), tokenizer()).count() == 0


@pytest.mark.parametrize("n, want", [(5, [(0, 5)]), (8, [(0, 8)]), (17, [(0, 8), (8, 8), (16, 1)])])
def test_cut(n, want):
    assert packing.cut(n, 8) == want
