"""The trie against dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from emberline.llm import conversation_trie as trie
from emberline.llm import queries

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    # The remainder keeps the sign of c, as in SQL.
    base = {c: c - (abs(c) % 5) * (1 if c >= 0 else -1) for c in own}
    return {c: tuple(own.get(base[c], [])[: h[c]] + own[c][h[c] :]) for c in own}


def brute(paths):
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), leaves[node], saved[node],
            sha(c for c in m if len(paths[c]) == len(node)),
        )
        for node, m in members.items()
    )


def asked(spark, tmp_path, rows, name="t"):
    at = tmp_path / name
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(at / "conversations.parquet"))
    got = queries.op13_turn_trie(spark, str(at)).select(*COLUMNS).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


def some(seed, n, most, longest=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, most) if c or not longest else longest):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "bot", None]), rng.choice(["", "é", "ab", None])))
    return rows


@pytest.mark.parametrize("width, pieces, limit", [(32, 1024, 40_000), (2, 2, 5)])
def test_against_dictionaries(spark, tmp_path, monkeypatch, width, pieces, limit):
    monkeypatch.setattr(trie, "WIDTH", width)
    monkeypatch.setattr(trie, "PIECES", pieces)
    monkeypatch.setattr(trie.nodes_with_digests, "__defaults__", (limit,))
    rows = some(1, 120, 14, 45) + [(500 + i, 0, "user", "same") for i in range(300)]
    rows += [(7, 3, "user", "ab")] * 40  # one turn, many times
    assert asked(spark, tmp_path, rows) == brute(rebuilt(rows))


def test_hot_conversation_and_lookups(spark, tmp_path, monkeypatch, forced_big):
    monkeypatch.setattr(trie, "WIDTH", 4)
    rows = some(2, 60, 6) + [(4, i, "user", "x") for i in range(700)] + [(5, i, "user", "x") for i in range(700)]
    assert asked(spark, tmp_path, rows) == brute(rebuilt(rows))


def test_edges(spark, tmp_path):
    long = "ü" * 300_000
    rows = [(None, 0, "user", "lost"), (-3, 0, None, None), (-3, 0, None, None), (-3, None, "user", ""), (12, None, None, long), (10, 1, "a", "1")]
    assert asked(spark, tmp_path, rows) == brute(rebuilt(rows))
    assert asked(spark, tmp_path, [(None, 1, "a", "b")], "none") == []
    assert asked(spark, tmp_path, [], "empty") == []


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, 0, "u", "x", 5, 6, 7, 8)], "conv_id long, turn long, role string, text string, conv int, `a.b` int, place int, _ int")
    assert trie.nodes_with_digests(*trie.rebuilt(df)).count() in (1, 2)
