"""Registered queries against their SQL counterparts, on the smallest data set.

Queries that first build all fires take some seconds each; here a few stand for them. ``check.py`` runs all.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical
from conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() == 150


def test_every_query_has_sql():
    assert set(entry.QUERIES) <= set(entry.queries()) and set(entry.QUERIES) <= set(entry.oracle_sql())


HEAVY_SAMPLE = {"w1_w2_fire_points", "a6_fire_area", "e1_fetch_fires", "n7_n8_n10_synthetic_points", "e2_build_environment"}
HEAVY_PREFIX = ("a2_", "a4_", "a6_", "a7_", "w1_", "g2_", "e1_", "e2_", "e4_", "j3_", "j5_", "j6_", "j8_", "j9_", "j11_", "n", "u1_")
NAMES = [n for n in entry.QUERIES if n in HEAVY_SAMPLE or not n.startswith(HEAVY_PREFIX)]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    answer = duck.execute(entry.oracle_sql()[name])
    want = canonical([d[0] for d in answer.description], answer.fetchall())
    assert canonical(df.columns, df.collect()) == want
    assert want[1]
