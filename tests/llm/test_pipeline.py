"""The registered queries on the smallest tables: against SQL, or stage by stage against plain versions."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, canonical
from conftest import SF
from emberline.llm import decontaminate, pii, queries, simhash
from emberline.llm.packing import LIMIT


@pytest.mark.parametrize("name", ["op8_risk_rules", "op9_fm_index", "op11_dyadic_runs", "op13_turn_trie"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    answer = con.execute(entry.oracle_sql()[name])
    assert canonical(df.columns, df.collect()) == canonical([d[0] for d in answer.description], answer.fetchall())


def test_registered_in_order():
    numbers = [int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")]
    assert numbers == list(range(1, 14)) and entry.queries()["pipeline"] is corpus_pipeline.run


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    after = stages[0](spark, docs, SF).cache()
    judged = queries.op8_risk_rules(spark, SF)
    assert after.schema == docs.schema
    assert set(rows(after)) == {r.doc_id for r in judged.where("kept").collect()}

    deduped = stages[1](spark, after, SF).cache()
    prints = {i: int.from_bytes(simhash.fingerprint(r.text), "big") for i, r in rows(after).items()}
    left, stay = dict(sorted(prints.items())), set()
    while left:
        first, fp = next(iter(left.items()))
        stay.add(first)
        todo = [left.pop(first)]
        while todo:
            fp = todo.pop()
            near = [i for i, x in left.items() if (x ^ fp).bit_count() <= simhash.DISTANCE]
            todo += [left.pop(i) for i in near]
    assert set(rows(deduped)) == stay and deduped.schema == docs.schema

    clean = stages[2](spark, deduped, SF).cache()
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.split_words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    spots = lambda t: [i for w in [decontaminate.split_words(t)] for i in range(len(w) - 9) if tuple(w[i : i + 10]) in windows]
    before, now = rows(deduped), rows(clean)
    assert not any(spots(r.text) for r in now.values())
    assert all(now[i] == before[i] for i in before if not spots(before[i].text)) and any(spots(r.text) for r in before.values())
    assert all(r.n_chars == len(r.text) for r in now.values())

    private = stages[3](spark, clean, SF).cache()
    found = pii.entities(clean).collect()
    assert found and private.schema == docs.schema
    hidden = rows(private)
    assert all(r.entity not in hidden[r.doc_id].text for r in found)
    touched = {r.doc_id for r in found}
    assert all(hidden[i] == now[i] for i in now if i not in touched)

    tokenizer = Tokenizer.from_str(queries.tokenizer())
    packed = stages[4](spark, private, SF).collect()
    ids = {i: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for i, r in hidden.items()}
    want = {(i, k): zlib.crc32(np.array(x[s : s + LIMIT], "<u4").tobytes()) for i, x in ids.items() for k, s in enumerate(range(0, len(x), LIMIT))}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in packed} == want
    room = {}
    for r in packed:
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert max(room.values()) <= LIMIT and len(room) <= -(-sum(map(len, ids.values())) // LIMIT) + 2


def test_stages_keep_columns_of_any_name(spark):
    """Names with dots and quotes, and names that the operators use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    odd = ["a.b", "_", "x`y", "_row", "_text", "_fp", "spans", "n_words", "kept", "c0", "none"]
    wide = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(odd)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, wide, SF)
        assert after.columns == wide.columns
        rows = after.collect()
        assert rows and all(r[-len(odd) :] == tuple(range(len(odd))) for r in map(tuple, rows))
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() >= 80
