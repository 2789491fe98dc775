import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberline.schema import HOTSPOT
from emberline.sources import tables


@pytest.fixture
def hot(spark):
    rows = [(i, 40.0 + i, 1.5, dt.date(2022 + i % 3, 5, 1), None if i == 1 else "n", 60.0 + i) for i in range(6)]
    return spark.createDataFrame(rows, HOTSPOT)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.createDataFrame([(float("nan"), "x"), (1.0, None)], "v double, t string"), path)
    assert {tuple(r) for r in tables.read_table(spark, path).collect()} == {(None, "x"), (1.0, None)}


def test_write_replaces(spark, tmp_path, hot):
    path = str(tmp_path / "t")
    tables.write_table(hot, path)
    tables.write_table(hot.limit(2), path)
    assert tables.read_table(spark, path, HOTSPOT).count() == 2


@pytest.mark.parametrize("sep, encoding", [(",", "utf-8"), (";", "ISO-8859-1")])
def test_csv_options(spark, tmp_path, sep, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes(f"ord{sep}latitude{sep}longitude{sep}acq_date{sep}confidence{sep}frp\n1{sep}40.5{sep}1{sep}2024-01-02{sep}ñ{sep}\n".encode(encoding))
    assert rows(tables.read_csv(spark, str(path), HOTSPOT, sep, encoding)) == [(1, 40.5, 1.0, dt.date(2024, 1, 2), "ñ", None)]


def test_csv_to_parquet(spark, tmp_path, hot):
    tables.write_csv(hot, str(tmp_path / "c"))
    got = tables.csv_to_parquet(spark, str(tmp_path / "c"), str(tmp_path / "p"), HOTSPOT)
    key = lambda r: r[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, hot.collect()), key=key)


def test_legend_with_a_nameless_code_column(spark, tmp_path):
    path = tmp_path / "legend.csv"
    path.write_text(",Name,Column6\n0,x,Agua\n7,y,Matorral\n,z,nada\n")
    assert {tuple(r) for r in tables.read_legend(spark, str(path)).collect()} == {(0, "Agua"), (7, "Matorral"), (None, "nada")}
    path.write_text("Unnamed: 0,Column6\n3,Ciudad\n")
    assert rows(tables.read_legend(spark, str(path))) == [(3, "Ciudad")]


def test_topic_years_are_partitions_and_others_survive(spark, tmp_path, hot):
    root = str(tmp_path)
    tables.write_topic(hot, root, "Incendios", "acq_date")
    tables.write_topic(hot.where("year(acq_date) = 2023").limit(1), root, "Incendios", "acq_date")
    counts = {r["year"]: r["count"] for r in tables.read_topic(spark, root, "Incendios").groupBy("year").count().collect()}
    assert counts == {2022: 2, 2023: 1, 2024: 2}
    picked = tables.read_topic(spark, root, "Incendios", [2024])
    assert picked.count() == 2
    assert "PartitionFilters: [isnotnull(year" in picked._jdf.queryExecution().executedPlan().toString()
    assert set(tables.read_topics(spark, root, ["Incendios"], [2022])) == {"Incendios"}


def test_topic_with_new_columns(spark, tmp_path, hot):
    root = str(tmp_path)
    tables.write_topic(hot.where("ord < 3"), root, "T", "acq_date")
    hot.where("ord > 3").withColumns({"year": F.year("acq_date"), "extra": F.lit(1)}).write.mode("append").partitionBy("year").parquet(f"{root}/T")
    assert tables.read_topic(spark, root, "T").where("extra IS NULL").count() == 3


def test_masks_by_region(spark, tmp_path):
    df = spark.createDataFrame([("Black Sea Bio-geographical Region", 0), ("Alpine Bio-geographical Region", 0)], "region string, part int")
    tables.write_by_region(df, str(tmp_path / "m"))
    assert {p.name for p in (tmp_path / "m").iterdir() if p.is_dir()} == {"region=BlackSeaRegion", "region=AlpineRegion"}


def test_label_union_is_stored_per_year_with_text_dates(spark, tmp_path, hot):
    path = str(tmp_path / "l")
    tables.write_label_union(hot.withColumnRenamed("acq_date", "date_first"), path)
    got = spark.read.parquet(path).where("year = 2022")
    assert {r["date_first"] for r in got.collect()} == {"2022-05-01"}


def test_csv_keeps_every_text(spark, tmp_path):
    texts = ['say "hi", ok', " Otro ", "", None, "a;b", "two\nlines", "back\\slash", '"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    tables.write_csv(df.coalesce(1), str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), df.schema, multi_line=True)
    assert {r.i: r.t for r in back.collect()} == dict(enumerate(texts))


def test_csv_of_others(spark, tmp_path):
    (tmp_path / "in.csv").write_text('i,t\n1,"say ""hi"", ok"\n2,plain\n', encoding="utf-8")
    assert [r.t for r in tables.read_csv(spark, str(tmp_path / "in.csv"), "i int, t string").collect()] == ['say "hi", ok', "plain"]


@pytest.mark.parametrize("split", ["128m", "2k"])
@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_source_order_whatever_the_splits(spark, tmp_path, kind, split):
    from emberline.operators import clean

    schema = StructType.fromDDL("latitude double, longitude double, acq_date string, frp double")
    rng = random.Random(3)
    rows = [(float(rng.randrange(4)), float(rng.randrange(3)), f"2024-01-0{rng.randrange(1, 4)}", float(i)) for i in range(3000)]
    for n, part in enumerate(("b", "a", "c")):  # written in another order than their names
        df = spark.createDataFrame(rows[n * 1000 : (n + 1) * 1000], schema).coalesce(1)
        if kind == "parquet":
            df.write.option("parquet.block.size", 4096).parquet(str(tmp_path / part))
        else:
            tables.write_csv(df, str(tmp_path / part))
    rows = rows[1000:2000] + rows[:1000] + rows[2000:]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = str(tmp_path / "*")
        read = tables.read_table(spark, path, schema, order="ord") if kind == "parquet" else tables.read_csv(spark, path, schema, order="ord")
        got = sorted((r.ord, r.frp) for r in read.select("ord", "frp").collect())
        assert got == [(i, r[3]) for i, r in enumerate(rows)]
        first = {}
        for i, (lat, lon, day, frp) in enumerate(rows):
            first.setdefault((lat, lon, day), (i, frp))
        kept = clean.dedup_first(read.repartition(7, "frp")).collect()
        assert {(r.latitude, r.longitude, r.acq_date): (r.ord, r.frp) for r in kept} == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_source_order_of_nothing(spark, tmp_path):
    schema = StructType.fromDDL("x double")
    tables.write_table(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert tables.read_table(spark, str(tmp_path / "none"), schema, order="ord").columns == ["x", "ord"]
    assert tables.read_table(spark, str(tmp_path / "none"), schema, order="ord").count() == 0


def test_declared_topic_opens_its_years_only(spark, tmp_path, hot):
    root = str(tmp_path)
    plain = hot.select("ord", "acq_date", "frp")
    tables.declare_topic(spark, root, "T", plain.schema, defaults={"frp": 0.5})
    tables.write_topic(plain.where("year(acq_date) = 2022"), root, "T", "acq_date")
    later = plain.where("year(acq_date) = 2024").drop("frp").withColumns({"odd.name": F.lit("x"), "_": F.lit(1)})
    tables.write_topic(later, root, "T", "acq_date")
    broken = tmp_path / "T" / "year=2023"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("no parquet")
    got = tables.read_topic(spark, root, "T", [2022, 2024])
    assert got.columns == ["ord", "acq_date", "frp", "odd.name", "_", "year"]
    rows = [(r["frp"], r["odd.name"], r["_"]) for r in got.where("year = 2024").collect()]
    assert rows and set(rows) == {(0.5, "x", 1)}
    assert {r["_"] for r in got.where("year = 2022").collect()} == {None}
    with pytest.raises(Exception):
        tables.read_topic(spark, root, "T").collect()


def test_declared_topic_keeps_types_and_knows_its_columns(spark, tmp_path, hot):
    root = str(tmp_path)
    assert tables.topic_schema(spark, root, "T") is None
    tables.declare_topic(spark, root, "T", hot.select("ord").schema)
    tables.declare_topic(spark, root, "T", hot.select("ord").schema)
    tables.declare_topic(spark, root, "T", hot.select("acq_date", "ord").schema)
    assert tables.topic_schema(spark, root, "T").names == ["ord", "acq_date"]
    with pytest.raises(ValueError, match="ord"):
        tables.write_topic(hot.select(F.col("ord").cast("string").alias("ord"), "acq_date"), root, "T", "acq_date")
    with pytest.raises(ValueError, match="defaults"):
        tables.declare_topic(spark, root, "U", hot.select("ord").schema, defaults={"x": 1})
    tables.write_topic(hot.select("ord", "acq_date").limit(0), root, "T", "acq_date")
    assert tables.read_topic(spark, root, "T").count() == 0
