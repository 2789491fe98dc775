import pytest

from emberline.operators import merge
from emberline.plans import jobs

LABELS = "lat double, lon double, date string, final int, area_ha double"
POINTS = [
    (1.0, 1.0, "2024-01-05", 1, 10.0),
    (1.0, 1.0, "2024-01-05 00:00:00", 1, 30.0),
    (2.0, 2.0, "2024-01-06", 0, None),
    (3.0, 3.0, "2024-02-06", 0, None),
    (None, 4.0, "2024-02-07", None, None),
]
VEG = [
    (1.0, 1.0, "2024-01-05", None, 1.0, 5),
    (2.0, 2.0, "2024-01-06", 0.5, float("nan"), 5),
    (3.0, 3.0, "2024-02-06", 0.5, 0.5, None),
    (None, 4.0, "2024-02-07", 1.0, 1.0, 5),
    (9.0, 9.0, "2024-02-07", None, None, 5),
]
SLOPE = [(1.0, 1.0, "2024-01-05", None), (1.0, 1.0, "2024-01-05", 3.0), (3.0, 3.0, "2024-02-06", 2.0)]


@pytest.fixture(params=["plain", "hot"])
def audit(request, spark, monkeypatch):
    if request.param == "hot":
        monkeypatch.setattr(merge.skew, "CHUNK", 1)  # a key with two rows is hot
    labels = spark.createDataFrame(POINTS, LABELS)
    veg = spark.createDataFrame(VEG, "lat double, lon double, date string, `a.b` double, _ double, final int")
    slope = spark.createDataFrame(SLOPE, "lat double, lon double, date string, area_ha double")
    return jobs.null_audit(labels, {"veg": veg, "slope": slope})


def test_by_column(audit):
    got = {(r.feature, r.final, r.column): (r.nulls, r.rows, r.rows_with_null) for r in audit.by_column().collect()}
    assert got[("veg", 1, "a.b")] == (2, 2, 2) and got[("veg", 0, "_")] == (1, 2, 1) and got[("veg", None, "lat")] == (1, 1, 1)
    assert got[("veg", 1, "lat")] == (0, 2, 2) and got[("slope", 1, "area_ha")] == (2, 4, 2) and got[("slope", 0, "area_ha")] == (0, 1, 0)
    assert len(got) == 3 * 5 + 2 * 4


def test_by_month_rows_areas_and_overlap(audit):
    months = {(r.feature, r.final, r.month): (r.rows, r.rows_with_null) for r in audit.by_month().collect()}
    assert months[("veg", 1, 1)] == (3, 2) and months[("veg", 0, 1)] == (3, 1) and months[("slope", 0, 2)] == (2, 0)
    assert len(months) == 2 * 4
    rows = sorted((r.feature, r.lat or 0, r.missing) for r in audit.rows().collect())
    assert rows == [("slope", 1.0, "area_ha")] * 2 + [("veg", 0, "lat"), ("veg", 1.0, "a.b"), ("veg", 1.0, "a.b"), ("veg", 2.0, "_")]
    areas = {(r.feature, r.bin): r.n for r in audit.areas(bins=2).collect()}
    assert areas == {(f, b): 1 for f in ("veg", "slope") for b in (1, 2)}
    overlap = {(r.final, r.month, r.features): r.points for r in audit.overlap().collect()}
    assert overlap == {(1, 1, "slope,veg"): 1, (0, 1, "veg"): 1, (None, 2, "veg"): 1}


def test_nothing_to_audit(spark):
    labels = spark.createDataFrame([], LABELS.replace(", area_ha double", ""))
    found = jobs.null_audit(labels, {"veg": spark.createDataFrame([], "lat double, lon double, date string, x double"), "keys": labels.drop("final")})
    for part in (found.by_column(), found.by_month(), found.rows(), found.areas(), found.overlap()):
        assert part.count() == 0


def test_points_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        base = spark.range(1000).selectExpr("CAST(id AS string) AS _merge_key", "id AS a")
        rights = [spark.range(1000).selectExpr("CAST(id AS string) AS _merge_key", f"id AS b{i}") for i in range(3)]
        joins = [j.selectExpr("a") for j in merge.inner_joins(base, rights)]
        plan = joins[0].union(joins[1]).union(joins[2])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReusedExchange") >= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
