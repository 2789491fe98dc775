"""Named queries over the driver's tables, each with its SQL counterpart."""

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberline.functions import geo, rounding
from emberline.functions.dates import clamped_date, day_prefix
from emberline.functions.geo import RasterMeta
from emberline.operators import clean, cluster, dissolve, enrich, events, quality, raster, synth, zones
from emberline.operators.lineage import checkpoint_root, settle
from emberline.operators.skew import shuffled
from emberline.plans import jobs
from emberline.plans.oracle import WATER_LIST, WEATHER_LIST, XA, XB, YA, YB, crossing, filled, medians, pixel, slopes, sql
from emberline.schema import HOTSPOT, WEATHER_COLUMNS
from emberline.sources import tables
from emberline.sources.fixtures import register
from emberline.sources.scenes import SceneStore

COVER_META = RasterMeta(-10.0, 56.0, 0.05, 0.05, 420, 820, -1.0)
SOIL_META = RasterMeta(-10.0, 56.0, 0.05, 0.05, 420, 820, -9999.0)
FEATURES = ("veg", "slope", "soil", "cover")
EPS_KM = 5.0


@dataclass(frozen=True)
class Query:
    needs: tuple[str, ...]
    build: Callable[[SparkSession], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, *self.needs)
        return self.build(spark)


QUERIES: dict[str, Query] = {}


def query(name: str, *needs: str, oracle: str | None = None):
    """Register a query under the id of the operator it shows."""

    def add(build):
        QUERIES[name] = Query(needs, build, sql(oracle.strip()) if oracle else None)
        return build

    return add


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/io-{uuid.uuid4().hex}"


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def fires_of(spark: SparkSession) -> DataFrame:
    return settle(jobs.fetch_fires(spark.table("hotspot")), "fires")


def fire_points_of(spark: SparkSession) -> DataFrame:
    """Fires as points to enrich."""
    return settle(
        fires_of(spark).select("fire_id", F.col("lat_mean").alias("lat"), F.col("lon_mean").alias("lon"), F.col("date_first").alias("date")),
        "fire-points",
    )


def split_of(spark: SparkSession) -> events.FireSplit:
    return events.separate_fire_events(clean.clean_hotspots(spark.table("hotspot")), EPS_KM)


def edges_of(spark: SparkSession) -> DataFrame:
    return zones.edges_from_vertices(spark.table("region_vertex"))


# ---- sources and sinks ----------------------------------------------------------------------------------


@query("s1_read_table", "hotspot", oracle="SELECT ord, latitude, longitude, acq_date, confidence, frp FROM hotspot")
def _(spark):
    path = scratch(spark)
    tables.write_table(spark.table("hotspot"), path)
    return tables.read_table(spark, path, HOTSPOT)


@query(
    "s2_rings",
    "region_vertex",
    oracle="""SELECT region, CAST(part AS INT) AS part, count(*) AS vertices, round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y
FROM region_vertex GROUP BY region, part""",
)
def _(spark):
    path = scratch(spark)
    vertices = spark.table("region_vertex").groupBy("region", "part")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    tables.write_table(vertices.agg(ordered.alias("ring")), path)
    edges = zones.edges_from_rings(tables.read_rings(spark, path))
    return edges.groupBy("region", "part").agg(
        F.count(F.lit(1)).alias("vertices"), F.round(F.sum("x2"), 6).alias("sum_x"), F.round(F.sum("y2"), 6).alias("sum_y")
    )


def _rings_in(spark: SparkSession, crs: str) -> DataFrame:
    """Vertices of rings that were stored in a projection and read as longitude and latitude."""
    path = scratch(spark)
    x, y = geo.PROJECTIONS[crs](F.col("x"), F.col("y"))
    placed = spark.table("region_vertex").select("region", "part", F.struct("seq", x.alias("x"), y.alias("y")).alias("v"))
    ring = F.transform(F.array_sort(F.collect_list("v")), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    tables.write_table(placed.groupBy("region", "part").agg(ring.alias("ring")), path)
    vertices = tables.read_rings(spark, path, crs).select("region", "part", F.posexplode("ring").alias("seq", "v"))
    return rounded(vertices.select("region", "part", "seq", "v.x", "v.y"), x=9, y=9)


_RINGS_SQL = """SELECT region, CAST(part AS INT) AS part, CAST(seq AS INT) AS seq, round(x, 9) AS x, round(y, 9) AS y FROM region_vertex"""


@query("s2_rings_in_3035", "region_vertex", oracle=_RINGS_SQL)
def _(spark):
    return _rings_in(spark, "EPSG:3035")


@query("s2_rings_in_6933", "region_vertex", oracle=_RINGS_SQL)
def _(spark):
    return _rings_in(spark, "EPSG:6933")


@query("s3_read_csv", "hotspot", oracle="SELECT ord, latitude, longitude, acq_date, confidence, frp FROM hotspot")
def _(spark):
    path = scratch(spark)
    spark.table("hotspot").write.option("header", True).option("sep", ";").csv(path)
    return tables.read_csv(spark, path, HOTSPOT, sep=";")


@query(
    "s4_read_legend",
    "hotspot",
    "land_cover_cell",
    "cover_legend",
    oracle=f"""SELECT coalesce(label, 'Sin datos') AS vegetacion2, count(*) AS n FROM (SELECT {pixel("latitude", "longitude")} FROM hotspot) h
LEFT JOIN land_cover_cell c ON c.row = h.row AND c.col = h.col LEFT JOIN cover_legend g ON g.code = c.value GROUP BY ALL""",
)
def _(spark):
    path = scratch(spark)
    legend = spark.table("cover_legend").select(F.col("code").alias("Unnamed: 0"), F.col("label").alias("Column6"))
    tables.write_csv(legend, path)
    coded = raster.sample(spark.table("hotspot"), spark.table("land_cover_cell"), COVER_META, "code", "latitude", "longitude")
    return raster.label(coded, tables.read_legend(spark, path), "code", "vegetacion2").groupBy("vegetacion2").agg(F.count(F.lit(1)).alias("n"))


@query("s5_write_table", "labelled_point", oracle="SELECT * FROM labelled_point")
def _(spark):
    path = scratch(spark)
    tables.write_table(spark.table("labelled_point"), path)
    tables.write_table(spark.table("labelled_point"), path)
    return tables.read_table(spark, path)


@query("s6_write_csv", "labelled_point", oracle="SELECT * FROM labelled_point")
def _(spark):
    path = scratch(spark)
    tables.write_csv(spark.table("labelled_point"), path)
    return tables.read_csv(spark, path, spark.table("labelled_point").schema)


@query("s7_csv_to_parquet", "hotspot", oracle="SELECT ord, latitude, longitude, acq_date, confidence, frp FROM hotspot")
def _(spark):
    source, target = scratch(spark), scratch(spark)
    tables.write_csv(spark.table("hotspot"), source)
    return tables.csv_to_parquet(spark, source, target, HOTSPOT)


@query(
    "s8_read_topic",
    "feature_slope",
    oracle="""SELECT lat, lon, date, elevacion_centro, grados, CAST(substring(date, 1, 4) AS INT) AS year FROM feature_slope
WHERE substring(date, 1, 4) IN ('1996', '1998')""",
)
def _(spark):
    root = scratch(spark)
    tables.write_topic(spark.table("feature_slope"), root, "Pendiente")
    return tables.read_topic(spark, root, "Pendiente", [1996, 1998])


@query(
    "s8_declared_topic",
    "feature_slope",
    oracle="""SELECT lat, lon, date, elevacion_centro, coalesce(CASE WHEN substring(date, 1, 4) = '1996' THEN grados END, -1) AS grados,
CASE WHEN substring(date, 1, 4) = '1997' THEN grados END AS steepest, CAST(substring(date, 1, 4) AS INT) AS year FROM feature_slope
WHERE substring(date, 1, 4) IN ('1996', '1997')""",
)
def _(spark):
    root = scratch(spark)
    slope = spark.table("feature_slope")
    of = lambda year: slope.where(F.col("date").startswith(str(year)))
    tables.declare_topic(spark, root, "Pendiente", slope.schema, defaults={"grados": -1.0})
    tables.write_topic(of(1996), root, "Pendiente")
    tables.write_topic(of(1997).withColumnRenamed("grados", "steepest"), root, "Pendiente")
    tables.write_topic(of(1998), root, "Pendiente")
    return tables.read_topic(spark, root, "Pendiente", [1996, 1997])


@query(
    "s8_read_year_files",
    "feature_slope",
    oracle="""SELECT lat, lon, date, elevacion_centro, grados, NULL::BIGINT AS extra FROM feature_slope WHERE substring(date, 1, 4) = '1996'
UNION ALL SELECT lat, lon, date, elevacion_centro, NULL, CAST(1 AS BIGINT) FROM feature_slope WHERE substring(date, 1, 4) = '1997'""",
)
def _(spark):
    root = scratch(spark)
    slope = spark.table("feature_slope")
    of = lambda year: slope.where(F.col("date").startswith(str(year)))
    tables.write_table(of(1996), f"{root}/Pendiente/north_1998.parquet")
    extended = of(1997).drop("grados").withColumn("extra", F.lit(1).cast("long"))
    tables.write_table(extended, f"{root}/Pendiente/south_1998.parquet")
    tables.write_table(of(1998), f"{root}/Pendiente/other_1999.parquet")
    return tables.read_year_files(spark, root, "Pendiente", 1998)


@query(
    "s9_read_topics",
    "feature_slope",
    "feature_veg",
    oracle="""SELECT 'Pendiente' AS topic, CAST(substring(date, 1, 4) AS INT) AS year, count(*) AS n FROM feature_slope WHERE substring(date, 1, 4) <= '1998' GROUP BY ALL
UNION ALL SELECT 'Vegetacion', CAST(substring(date, 1, 4) AS INT), count(*) FROM feature_veg WHERE substring(date, 1, 4) <= '1998' GROUP BY ALL""",
)
def _(spark):
    root = scratch(spark)
    tables.write_topic(spark.table("feature_slope"), root, "Pendiente")
    tables.write_topic(spark.table("feature_veg"), root, "Vegetacion")
    read = tables.read_topics(spark, root, ["Pendiente", "Vegetacion"], range(1992, 1999))
    counted = [df.groupBy("year").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("topic"), "year", "n") for t, df in read.items()]
    return counted[0].unionByName(counted[1])


@query(
    "s10_write_by_region",
    "region_vertex",
    oracle="SELECT region || 'Region' AS region, count(*) AS n FROM region_vertex GROUP BY region",
)
def _(spark):
    path = scratch(spark)
    named = spark.table("region_vertex").withColumn("region", F.concat(F.col("region"), F.lit(" Bio-geographical Region")))
    tables.write_by_region(named, path)
    return spark.read.parquet(path).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s11_write_label_union",
    "labelled_point",
    oracle="""SELECT point_id, round(lat, 6) AS lat_mean, round(lon, 6) AS lon_mean, substring(date, 1, 10) AS date_first, area_ha,
CAST(final AS INT) AS final, CAST(substring(date, 1, 4) AS INT) AS year FROM labelled_point""",
)
def _(spark):
    path = scratch(spark)
    points = spark.table("labelled_point").withColumn("date", day_prefix(F.col("date")))
    fires = points.where("final = 1").withColumnsRenamed({"lat": "lat_mean", "lon": "lon_mean", "date": "date_first"}).drop("final")
    labelled = jobs.label_union(fires, points.where("final = 0").drop("final", "area_ha"))
    tables.write_label_union(labelled, path)
    out = spark.read.parquet(path).select("point_id", "lat_mean", "lon_mean", "date_first", "area_ha", "final", "year")
    return rounded(out, lat_mean=6, lon_mean=6)


# ---- cleaning -------------------------------------------------------------------------------------------


@query("p1_drop_low_confidence", "hotspot", oracle="SELECT * FROM hotspot WHERE confidence IS DISTINCT FROM 'l'")
def _(spark):
    return clean.drop_low_confidence(spark.table("hotspot"))


@query("p2_min_frp", "hotspot", oracle="SELECT * FROM hotspot WHERE frp > 50")
def _(spark):
    return clean.min_frp(spark.table("hotspot"))


@query(
    "a1_dedup_first",
    "hotspot",
    oracle="""SELECT latitude, longitude, acq_date, frp, ord FROM (SELECT *, row_number() OVER
(PARTITION BY latitude, longitude, acq_date ORDER BY ord) AS rn FROM hotspot) WHERE rn = 1""",
)
def _(spark):
    return clean.dedup_first(spark.table("hotspot"))


_SOURCE_ORDER_SQL = """SELECT latitude, longitude, acq_date, frp, ord FROM (SELECT *, row_number() OVER
(PARTITION BY latitude, longitude, acq_date ORDER BY ord) AS rn FROM (SELECT * REPLACE (row_number() OVER (ORDER BY ord) - 1 AS ord) FROM hotspot)) WHERE rn = 1"""


def _in_files(spark: SparkSession) -> DataFrame:
    """Hotspots as a source has them: in order over several files, the order itself not a column."""
    return spark.table("hotspot").repartitionByRange(5, "ord").sortWithinPartitions("ord").drop("ord")


@query("a1_s1_source_order", "hotspot", oracle=_SOURCE_ORDER_SQL)
def _(spark):
    path = scratch(spark)
    tables.write_table(_in_files(spark), path)
    return clean.dedup_first(tables.read_table(spark, path, order="ord"))


@query("a1_s3_source_order", "hotspot", oracle=_SOURCE_ORDER_SQL)
def _(spark):
    path = scratch(spark)
    tables.write_csv(_in_files(spark), path)
    schema = StructType([f for f in HOTSPOT if f.name != "ord"])
    return clean.dedup_first(tables.read_csv(spark, path, schema, order="ord"))


@query("p3_p4_clean_hotspots", "hotspot", oracle="SELECT * FROM clean_point")
def _(spark):
    text = spark.table("hotspot").withColumn("acq_date", F.date_format("acq_date", "yyyy-MM-dd"))
    return clean.clean_hotspots(text)


@query(
    "p5_date_range",
    "hotspot",
    oracle="SELECT * FROM clean_point WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-19'",
)
def _(spark):
    return clean.date_range(clean.clean_hotspots(spark.table("hotspot")), "2024-01-05", "2024-01-19")


@query(
    "p6_date_range_text",
    "labelled_point",
    oracle="""SELECT point_id, CAST(substring(date, 1, 10) AS DATE) AS date FROM labelled_point
WHERE substring(date, 1, 10) BETWEEN '1996-03-01' AND '1996-09-30'""",
)
def _(spark):
    days = quality.normalise_date(spark.table("labelled_point")).select("point_id", "date")
    return clean.date_range(days, "1996-03-01", "1996-09-30")


@query(
    "p7_normalise_date",
    "labelled_point",
    oracle="SELECT point_id, CAST(substring(date, 1, 10) AS DATE) AS date FROM labelled_point",
)
def _(spark):
    return quality.normalise_date(spark.table("labelled_point")).select("point_id", "date")


@query(
    "p8_day_prefix",
    "labelled_point",
    oracle="SELECT CAST(substring(date, 1, 10) AS DATE) AS date, count(*) AS n FROM labelled_point GROUP BY ALL",
)
def _(spark):
    return spark.table("labelled_point").groupBy(day_prefix(F.col("date")).alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p9_date_text",
    "hotspot",
    oracle="SELECT ord, CAST(acq_date AS VARCHAR) AS acq_date FROM hotspot",
)
def _(spark):
    path = scratch(spark)
    tables.write_table(spark.table("hotspot").select("ord", "acq_date"), path, date_as_text=["acq_date"])
    return spark.read.parquet(path)


@query("p10_head", "hotspot", oracle="SELECT * FROM hotspot ORDER BY frp DESC, ord LIMIT 100")
def _(spark):
    return clean.head(spark.table("hotspot"), 100, F.desc("frp"), "ord")


@query(
    "p13_clamped_date",
    "hotspot",
    oracle="""SELECT ord, make_date(CAST(year(acq_date) AS BIGINT), CAST(2 AS BIGINT), CAST(least(day(acq_date), 28) AS BIGINT)) AS date FROM hotspot""",
)
def _(spark):
    return spark.table("hotspot").select("ord", clamped_date(F.year("acq_date"), F.lit(2), F.dayofmonth("acq_date")).alias("date"))


@query(
    "p17_slope_percent",
    "feature_slope",
    oracle="SELECT lat, lon, date, round(coalesce(tan(radians(grados)) * 100, 0), 6) AS porcentaje FROM feature_slope",
)
def _(spark):
    return spark.table("feature_slope").select("lat", "lon", "date", F.round(enrich.slope_percent(F.col("grados")), 6).alias("porcentaje"))


@query(
    "p18_p19_p20_rounding",
    "hotspot",
    oracle="""SELECT ord, round_even(latitude * 100, 0) / 100 AS lat_r, round_even(frp, 1) AS frp_r,
CAST(round_even(frp / 2, 0) AS BIGINT) AS n FROM hotspot""",
)
def _(spark):
    return spark.table("hotspot").select(
        "ord",
        rounding.np_round(F.col("latitude"), 2).alias("lat_r"),
        rounding.py_round(F.col("frp"), 1).alias("frp_r"),
        rounding.to_count(F.col("frp") / 2).alias("n"),
    )


# ---- clustering and events ------------------------------------------------------------------------------


def _cell_sql(alias: str) -> str:
    side, origin = repr(cluster.cell_side(EPS_KM)), cluster.ORIGIN
    lat, lon = f"radians({alias}.lat)", f"radians({alias}.lon)"
    parts = (f"cos({lat}) * cos({lon})", f"cos({lat}) * sin({lon})", f"sin({lat})")
    keys = [f"(CAST(floor({p} / {side}) AS BIGINT) + {origin})" for p in parts]
    return f"{keys[0]} * {1 << 42} + {keys[1]} * {1 << 21} + {keys[2]}"


@query(
    "j1_linked_cells",
    "hotspot",
    oracle=f"""SELECT DISTINCT x.cell AS a_cell, y.cell AS b_cell FROM near_pair p
JOIN (SELECT ord, {_cell_sql("c")} AS cell FROM clean_point c) x ON x.ord = p.a
JOIN (SELECT ord, {_cell_sql("c")} AS cell FROM clean_point c) y ON y.ord = p.b WHERE x.cell < y.cell""",
)
def _(spark):
    points = settle(cluster.with_cell(clean.clean_hotspots(spark.table("hotspot")), EPS_KM), "points")
    return cluster.linked_cells(points, EPS_KM)


@query(
    "a2_a3_components",
    "hotspot",
    oracle="SELECT ord, first_ord, label FROM fire_component",
)
def _(spark):
    points = settle(cluster.with_cell(clean.clean_hotspots(spark.table("hotspot")), EPS_KM), "points")
    named = settle(shuffled(points.select("ord", "cell")).join(cluster.components(points, EPS_KM), "cell"), "named")
    first = settle(named.groupBy("component").agg(F.min("ord").alias("first_ord")), "first")
    return shuffled(named).join(cluster.label(first), "component").select("ord", "first_ord", "label")


@query(
    "w1_w2_fire_points",
    "hotspot",
    oracle="SELECT ord, lat_r AS lat, lon_r AS lon, frp, date, fire_id FROM fire_point",
)
def _(spark):
    return split_of(spark).labelled_points()


@query(
    "w1_gap_split",
    "hotspot",
    oracle="""SELECT label, date, min(ord) AS first_ord, CAST(max(split) AS INT) AS split FROM gap_row GROUP BY label, date""",
)
def _(spark):
    return split_of(spark).days.select("label", "date", "first_ord", F.col("split").cast("int").alias("split"))


_SUMMARY_SQL = """SELECT fire_id, round(lat_mean, 8) AS lat_mean, round(lon_mean, 8) AS lon_mean, round(frp_sum, 4) AS frp_sum,
round(frp_mean, 8) AS frp_mean, count, date_first, date_last, duration_days"""


@query("a4_a5_fire_summary", "hotspot", oracle=f"{_SUMMARY_SQL} FROM fire_sum")
def _(spark):
    return rounded(events.fire_summary(split_of(spark).labelled_points()), lat_mean=8, lon_mean=8, frp_sum=4, frp_mean=8)


@query("a6_fire_area", "hotspot", oracle="SELECT fire_id, round(area_ha, 1) AS area_ha FROM fire_ha")
def _(spark):
    return rounded(events.fire_area(split_of(spark).labelled_points(), 375.0), area_ha=1)


@query(
    "g2_to_6933",
    "hotspot",
    oracle="SELECT fire_id, round(min(x), 3) AS x, round(max(y), 3) AS y FROM hull_place GROUP BY fire_id",
)
def _(spark):
    x, y = geo.to_6933(F.col("lon"), F.col("lat"))
    points = split_of(spark).labelled_points()
    return points.groupBy("fire_id").agg(F.round(F.min(x), 3).alias("x"), F.round(F.max(y), 3).alias("y"))


@query(
    "e1_fetch_fires",
    "hotspot",
    oracle=f"{_SUMMARY_SQL}, round(area_ha, 1) AS area_ha FROM fire_row ORDER BY count DESC, fire_id",
)
def _(spark):
    fires = jobs.fetch_fires(spark.table("hotspot"))
    return rounded(fires, lat_mean=8, lon_mean=8, frp_sum=4, frp_mean=8, area_ha=1)


@query(
    "w1_input_order",
    "hotspot",
    oracle="""SELECT fire_id, round(avg(round_even(lat * 100, 0)) / 100, 6) AS lat_mean, round(CAST(sum(CAST(frp AS DECIMAL(20,6))) AS DOUBLE), 4) AS frp_sum,
count(*) AS count, arg_min(date, ord) AS date_first, arg_max(date, ord) AS date_last,
CAST(date_diff('day', arg_min(date, ord), arg_max(date, ord)) + 1 AS INT) AS duration_days FROM shuffled_fire_point GROUP BY fire_id""",
)
def _(spark):
    fires = jobs.fetch_fires(spark.table("hotspot"), order="input").drop("lon_mean", "frp_mean", "area_ha")
    return rounded(fires, lat_mean=6, frp_sum=4)


# ---- regions --------------------------------------------------------------------------------------------


@query(
    "j2_assign_region",
    "hotspot",
    "region_vertex",
    oracle=f"""SELECT ord, region FROM hotspot CROSS JOIN region_edge WHERE {crossing("longitude", "latitude")}
GROUP BY ord, region HAVING count(*) % 2 = 1""",
)
def _(spark):
    return zones.assign_region(spark.table("hotspot"), edges_of(spark), "latitude", "longitude").select("ord", "region")


@query(
    "a7_region_stats",
    "hotspot",
    "region_vertex",
    oracle="SELECT region, fires, round(frp_total, 3) AS frp_total FROM region_stat",
)
def _(spark):
    edges = edges_of(spark)
    return rounded(zones.region_stats(zones.assign_region(fires_of(spark), edges), edges), frp_total=3)


@query("a8_region_area", "region_vertex", oracle="SELECT region, round(area_km2, 2) AS area_km2 FROM region_km2")
def _(spark):
    return rounded(zones.region_area(edges_of(spark)), area_km2=2)


def country_edges(spark: SparkSession) -> DataFrame:
    vertices = spark.table("country_vertex")
    continents = vertices.select(F.col("country").alias("region"), "continent").distinct()
    return zones.edges_from_vertices(vertices, "country").join(continents, "region")


@query(
    "a9_p16_dissolve",
    "hotspot",
    "country_vertex",
    oracle=f"""SELECT ord, continent AS region FROM (SELECT ord, country, continent FROM hotspot CROSS JOIN country_edge
WHERE continent IN ('EUROPE', 'ASIA') AND {crossing("longitude", "latitude")} GROUP BY ord, country, continent HAVING count(*) % 2 = 1)
GROUP BY ord, continent""",
)
def _(spark):
    edges = country_edges(spark)
    masks = zones.dissolve(edges, F.col("continent"), F.col("continent").isin("EUROPE", "ASIA"))
    return zones.assign_region(spark.table("hotspot"), masks, "latitude", "longitude").select("ord", "region")


@query(
    "a9_dissolved_outline",
    "country_vertex",
    oracle=f"""WITH o AS (SELECT continent, x1, y1, x2, y2, row_number() OVER (ORDER BY continent, x1, y1, x2, y2) AS id FROM country_edge a WHERE NOT EXISTS
  (SELECT 1 FROM country_edge b WHERE b.continent = a.continent AND b.x1 = a.x2 AND b.y1 = a.y2 AND b.x2 = a.x1 AND b.y2 = a.y1)),
follows AS (SELECT a.id, arg_max(b.id, atan2((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1), (a.x2 - a.x1) * (b.x2 - b.x1) + (a.y2 - a.y1) * (b.y2 - b.y1))) AS next
  FROM o a JOIN o b ON b.continent = a.continent AND b.x1 = a.x2 AND b.y1 = a.y2 GROUP BY a.id),
walk AS (SELECT id, next FROM follows UNION SELECT w.id, f.next FROM walk w JOIN follows f ON f.id = w.next),
ring AS (SELECT id, min(next) AS ring FROM walk GROUP BY id)
SELECT continent AS region, count(DISTINCT ring) AS n_rings, count(*) AS n_edges, round(abs(sum({XA} * {YB} - {XB} * {YA})) / 2e6, 2) AS area_km2,
  round(sum(sqrt(pow({XB} - {XA}, 2) + pow({YB} - {YA}, 2))) / 1e3, 4) AS perimeter_km FROM o JOIN ring r ON r.id = o.id GROUP BY continent""",
)
def _(spark):
    masks = zones.dissolve(country_edges(spark), F.col("continent"))
    return rounded(dissolve.outline_stats(dissolve.dissolve_rings(masks)), area_km2=2, perimeter_km=4)


@query(
    "a9_dissolved_points",
    "hotspot",
    "country_vertex",
    oracle=f"""SELECT ord, continent AS region FROM hotspot CROSS JOIN country_edge WHERE {crossing("longitude", "latitude")}
GROUP BY ord, continent HAVING count(*) % 2 = 1""",
)
def _(spark):
    path = scratch(spark)
    masks = zones.dissolve(country_edges(spark), F.col("continent"))
    tables.write_table(dissolve.rings(dissolve.dissolve_rings(masks)), path)
    stored = zones.edges_from_rings(tables.read_rings(spark, path))
    return zones.assign_region(spark.table("hotspot"), stored, "latitude", "longitude").select("ord", "region")


@query("g6_region_bbox", "region_vertex", oracle="SELECT region, min_x, max_x, min_y, max_y FROM region_box")
def _(spark):
    return zones.region_bbox(edges_of(spark))


# ---- rasters and enrichment -----------------------------------------------------------------------------


@query(
    "j4_raster_sample",
    "hotspot",
    "soil_cell",
    oracle=f"""SELECT ord, CASE WHEN c.value >= 0 THEN c.value END AS "SOC" FROM (SELECT ord, {pixel("latitude", "longitude")} FROM hotspot) h
LEFT JOIN soil_cell c ON c.row = h.row AND c.col = h.col""",
)
def _(spark):
    hot = spark.table("hotspot").select("ord", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return enrich.add_soil(hot, spark.table("soil_cell"), SOIL_META).select("ord", "SOC")


@query(
    "j5_raster_fill_mode",
    "hotspot",
    "land_cover_cell",
    oracle="SELECT p.fire_id, f.value AS code FROM fire_pixel p LEFT JOIN fire_fill f ON f.row = p.row AND f.col = p.col",
)
def _(spark):
    return raster.sample_filled(fire_points_of(spark), spark.table("land_cover_cell"), COVER_META, "code").select("fire_id", "code")


@query(
    "j5_raster_fill_mean",
    "hotspot",
    "land_cover_cell",
    oracle="""SELECT p.fire_id, round(CASE WHEN c.value >= 0 THEN c.value ELSE (SELECT avg(n.value) FROM land_cover_cell n
WHERE n.row BETWEEN p.row - 3 AND p.row + 1 AND n.col BETWEEN p.col - 3 AND p.col + 1 AND n.value >= 0) END, 6) AS code
FROM fire_pixel p LEFT JOIN land_cover_cell c ON c.row = p.row AND c.col = p.col""",
)
def _(spark):
    sampled = raster.sample_filled(fire_points_of(spark), spark.table("land_cover_cell"), COVER_META, "code", "mean", 5, -3)
    return rounded(sampled.select("fire_id", "code"), code=6)


@query(
    "j6_land_cover",
    "hotspot",
    "land_cover_cell",
    "cover_legend",
    oracle="""SELECT p.fire_id, coalesce(label, 'Sin datos') AS vegetacion2 FROM fire_pixel p
LEFT JOIN fire_fill f ON f.row = p.row AND f.col = p.col LEFT JOIN cover_legend g ON g.code = f.value""",
)
def _(spark):
    points = enrich.add_land_cover(fire_points_of(spark), spark.table("land_cover_cell"), spark.table("cover_legend"), COVER_META)
    return points.select("fire_id", "vegetacion2")


@query(
    "j7_drop_water_urban",
    "feature_cover",
    "cover_legend",
    oracle=f"""SELECT lat, lon, date, vegetacion2 FROM feature_cover WHERE NOT EXISTS
(SELECT 1 FROM cover_legend WHERE code IN ({WATER_LIST}) AND label = vegetacion2)""",
)
def _(spark):
    return quality.drop_water_urban(spark.table("feature_cover"), spark.table("cover_legend")).select("lat", "lon", "date", "vegetacion2")


@query(
    "j8_weather",
    "hotspot",
    "weather_daily",
    oracle=f"""SELECT p.fire_id, {WEATHER_LIST} FROM fire_pixel p
LEFT JOIN weather_daily w ON w.row = p.row AND w.col = p.col AND w.date = p.date""",
)
def _(spark):
    return enrich.add_weather(fire_points_of(spark), spark.table("weather_daily"), COVER_META).select("fire_id", *WEATHER_COLUMNS)


_VEG_SQL = f"""SELECT p.fire_id, round(m.NDVI, 6) AS "NDVI", round(m.NDWI, 6) AS "NDWI"
FROM fire_pixel p LEFT JOIN ({medians("fire_pixel", "fire_id")}) m ON m.fire_id = p.fire_id"""


@query("j9_j10_a10_veg_index", "hotspot", "s2_scene", "s2_cloud", oracle=_VEG_SQL)
def _(spark):
    points = enrich.add_veg_index(fire_points_of(spark), spark.table("s2_scene"), spark.table("s2_cloud"), COVER_META)
    return rounded(points.select("fire_id", "NDVI", "NDWI"), NDVI=6, NDWI=6)


@query("j9_j10_a10_stored_scenes", "hotspot", "s2_scene", "s2_cloud", oracle=_VEG_SQL)
def _(spark):
    store = SceneStore.of(scratch(spark), COVER_META)
    store.write(spark.table("s2_scene"), spark.table("s2_cloud"))
    points = enrich.add_veg_index_stored(fire_points_of(spark), store, COVER_META)
    return rounded(points.select("fire_id", "NDVI", "NDWI"), NDVI=6, NDWI=6)


_POINT_PIXEL_SQL = f"""(SELECT latitude AS lat, longitude AS lon, acq_date AS date, ord AS fire_id, {pixel("latitude", "longitude")} FROM hotspot)"""


def hotspot_points(spark: SparkSession) -> DataFrame:
    return spark.table("hotspot").select(
        F.col("latitude").alias("lat_mean"), F.col("longitude").alias("lon_mean"), F.col("acq_date").alias("date_first")
    )


@query(
    "e5_slope_table",
    "hotspot",
    "dem_cell",
    oracle=f"""SELECT p.lat, p.lon, p.date, elevacion_centro, round(grados, 6) AS grados, round(coalesce(tan(radians(grados)) * 100, 0), 6) AS porcentaje
FROM {_POINT_PIXEL_SQL} p JOIN ({slopes("point_pixel", "fire_id")}) s ON s.fire_id = p.fire_id""".replace("point_pixel", _POINT_PIXEL_SQL),
)
def _(spark):
    return rounded(enrich.terrain(hotspot_points(spark), spark.table("dem_cell"), SOIL_META), grados=6, porcentaje=6)


@query(
    "e5_vegetation_table",
    "hotspot",
    "s2_scene",
    "s2_cloud",
    oracle=f"""SELECT p.lat, p.lon, p.date, round(m.NDVI, 6) AS "NDVI", round(m.NDWI, 6) AS "NDWI"
FROM {_POINT_PIXEL_SQL} p LEFT JOIN ({medians("point_pixel", "fire_id")}) m ON m.fire_id = p.fire_id""".replace("point_pixel", _POINT_PIXEL_SQL),
)
def _(spark):
    found = enrich.veg_index(hotspot_points(spark), spark.table("s2_scene"), spark.table("s2_cloud"), COVER_META)
    return rounded(found, NDVI=6, NDWI=6)


@query(
    "e5_cover_table",
    "hotspot",
    "land_cover_cell",
    "cover_legend",
    oracle=f"""WITH point_pixel AS {_POINT_PIXEL_SQL} SELECT p.lat, p.lon, p.date, coalesce(label, 'Sin datos') AS vegetacion2 FROM point_pixel p
LEFT JOIN ({filled("point_pixel")}) f ON f.row = p.row AND f.col = p.col LEFT JOIN cover_legend g ON g.code = f.value""",
)
def _(spark):
    found = enrich.land_cover(hotspot_points(spark), spark.table("land_cover_cell"), spark.table("cover_legend"), COVER_META)
    return found.select("lat", "lon", "date", "vegetacion2")


@query(
    "j11_a11_terrain",
    "hotspot",
    "dem_cell",
    oracle=f"""SELECT fire_id, elevacion_centro, round(grados, 6) AS grados, round(coalesce(tan(radians(grados)) * 100, 0), 6) AS porcentaje
FROM ({slopes("fire_pixel", "fire_id")})""",
)
def _(spark):
    points = enrich.add_terrain(fire_points_of(spark), spark.table("dem_cell"), SOIL_META)
    return rounded(points.select("fire_id", "elevacion_centro", "grados", "porcentaje"), grados=6, porcentaje=6)


@query(
    "e5_weather_table",
    "hotspot",
    "weather_daily",
    oracle=f"""SELECT p.lat, p.lon, p.date, {WEATHER_LIST} FROM (SELECT latitude AS lat, longitude AS lon, acq_date AS date,
{pixel("latitude", "longitude")} FROM hotspot WHERE acq_date IS NOT NULL) p
LEFT JOIN weather_daily w ON w.row = p.row AND w.col = p.col AND w.date = p.date""",
)
def _(spark):
    points = spark.table("hotspot").select(
        F.col("latitude").alias("lat_mean"), F.col("longitude").alias("lon_mean"), F.col("acq_date").alias("date_first")
    )
    return enrich.weather(points, spark.table("weather_daily"), COVER_META)


@query(
    "e5_soil_table",
    "hotspot",
    "soil_cell",
    oracle=f"""SELECT CASE WHEN c.value >= 0 THEN c.value END AS "SOC", p.lat, p.lon, p.date FROM (SELECT latitude AS lat, longitude AS lon,
acq_date AS date, {pixel("latitude", "longitude")} FROM hotspot) p LEFT JOIN soil_cell c ON c.row = p.row AND c.col = p.col""",
)
def _(spark):
    points = spark.table("hotspot").select(
        F.col("latitude").alias("lat_mean"), F.col("longitude").alias("lon_mean"), F.col("acq_date").alias("date_first")
    )
    return enrich.soil(points, spark.table("soil_cell"), SOIL_META)


# ---- synthetic points -----------------------------------------------------------------------------------


@query(
    "n1_n2_quotas",
    "hotspot",
    "region_vertex",
    oracle="""SELECT region, fires, round(frp_total, 3) AS frp_total, round(area_km2, 2) AS area_km2, quota FROM region_quota""",
)
def _(spark):
    fires, edges = fires_of(spark), edges_of(spark)
    quota = synth.quotas(zones.assign_region(fires, edges), edges, fires.count())
    return rounded(quota, frp_total=3, area_km2=2)


def _near_plan(spark):
    fires, edges = fires_of(spark), edges_of(spark)
    assigned = settle(zones.assign_region(fires, edges), "assigned")
    quota = settle(synth.quotas(assigned, edges, fires.count()), "quota")
    return fires, synth.near_counts(assigned, quota, quota.count())


@query(
    "n3_near_counts", "hotspot", "region_vertex", oracle="SELECT fire_id, region, CAST(n_near AS BIGINT) AS n_near FROM near_plan"
)
def _(spark):
    return _near_plan(spark)[1].select("fire_id", "region", "n_near")


@query(
    "n4_months",
    "hotspot",
    "region_vertex",
    oracle="SELECT fire_id, region, month, CAST(n AS BIGINT) AS n FROM near_month",
)
def _(spark):
    return synth.spread_over_year(_near_plan(spark)[1]).select("fire_id", "region", "month", "n")


@query(
    "n5_near_candidates",
    "hotspot",
    "region_vertex",
    oracle="SELECT point_id, region, source, round(lat, 6) AS lat, round(lon, 6) AS lon, date FROM near_point",
)
def _(spark):
    candidates = synth.near_candidates(synth.spread_over_year(_near_plan(spark)[1]), 42)
    return rounded(candidates, lat=6, lon=6)


@query(
    "n6_n9_checked",
    "hotspot",
    "region_vertex",
    "land_cover_cell",
    oracle="SELECT point_id, valid FROM near_check",
)
def _(spark):
    fires, plan = _near_plan(spark)
    candidates = synth.near_candidates(synth.spread_over_year(plan), 42)
    return synth.checked(candidates, fires, fires.count(), spark.table("land_cover_cell"), COVER_META).select("point_id", "valid")


@query(
    "j3_not_a_fire",
    "hotspot",
    oracle="""SELECT ord FROM clean_point c WHERE NOT EXISTS (SELECT 1 FROM fire_sum s WHERE s.lat_mean = c.lat AND s.lon_mean = c.lon)""",
)
def _(spark):
    return synth.not_a_fire(clean.clean_hotspots(spark.table("hotspot")), fires_of(spark)).select("ord")


@query(
    "n7_n8_n10_synthetic_points",
    "hotspot",
    "region_vertex",
    "land_cover_cell",
    oracle="SELECT point_id, region, source, round(lat, 6) AS lat, round(lon, 6) AS lon, date FROM synthetic_row",
)
def _(spark):
    points = synth.synthetic_points(fires_of(spark), edges_of(spark), spark.table("land_cover_cell"), COVER_META)
    return rounded(points, lat=6, lon=6)


@query(
    "e2_build_environment",
    "hotspot",
    "region_vertex",
    "land_cover_cell",
    "cover_legend",
    "weather_daily",
    "s2_scene",
    "s2_cloud",
    "dem_cell",
    oracle=f"""SELECT coalesce(label, 'Sin datos') AS vegetacion2, t.point_id, t.fire_id, round(lat_mean, 6) AS lat_mean, round(lon_mean, 6) AS lon_mean,
round(frp_sum, 4) AS frp_sum, count, date_first, round(area_ha, 1) AS area_ha, CAST(final AS INT) AS final, {WEATHER_LIST},
round(m.NDVI, 6) AS "NDVI", round(m.NDWI, 6) AS "NDWI", elevacion_centro, round(grados, 6) AS grados,
round(coalesce(tan(radians(grados)) * 100, 0), 6) AS porcentaje
FROM e2_point t LEFT JOIN e2_fill f ON f.row = t.row AND f.col = t.col LEFT JOIN cover_legend g ON g.code = f.value
LEFT JOIN weather_daily w ON w.row = t.row AND w.col = t.col AND w.date = t.date
LEFT JOIN ({medians("e2_point", "point_id")}) m ON m.point_id = t.point_id
LEFT JOIN ({slopes("e2_point", "point_id")}) d ON d.point_id = t.point_id""",
)
def _(spark):
    t = spark.table
    env = jobs.build_environment(
        t("hotspot"), edges_of(spark), t("land_cover_cell"), t("cover_legend"), t("weather_daily"), t("s2_scene"),
        t("s2_cloud"), t("dem_cell"), COVER_META, dem_meta=SOIL_META,
    )
    out = env.select(
        "vegetacion2", "point_id", "fire_id", "lat_mean", "lon_mean", "frp_sum", "count", "date_first", "area_ha", "final",
        *WEATHER_COLUMNS, "NDVI", "NDWI", "elevacion_centro", "grados", "porcentaje",
    )
    return rounded(out, lat_mean=6, lon_mean=6, frp_sum=4, area_ha=1, NDVI=6, NDWI=6, grados=6, porcentaje=6)


# ---- features and quality -------------------------------------------------------------------------------

_ON = "x.lat IS NOT DISTINCT FROM l.lat AND x.lon IS NOT DISTINCT FROM l.lon AND substring(x.date, 1, 10) IS NOT DISTINCT FROM substring(l.date, 1, 10)"


def _feature_sql(name: str, columns: str) -> str:
    return f"""SELECT l.lat, l.lon, CAST(substring(l.date, 1, 10) AS DATE) AS date, CAST(l.final AS INT) AS final, {columns}
FROM labelled_point l JOIN feature_{name} x ON {_ON}"""


_COLUMNS = {"veg": ("NDVI", "NDWI"), "slope": ("elevacion_centro", "grados"), "soil": ("SOC",), "cover": ("vegetacion2",)}


def _quoted(name: str) -> str:
    return ", ".join(f'x.{c} AS "{c}"' for c in _COLUMNS[name])


_MERGED_SQL = f"""SELECT l.point_id, l.lat, l.lon, CAST(substring(l.date, 1, 10) AS DATE) AS date, CAST(l.final AS INT) AS final, l.area_ha,
a.NDVI AS "NDVI", a.NDWI AS "NDWI", b.elevacion_centro, b.grados, c.SOC AS "SOC", d.vegetacion2 FROM labelled_point l
LEFT JOIN feature_veg a ON {_ON.replace("x.", "a.")} LEFT JOIN feature_slope b ON {_ON.replace("x.", "b.")}
LEFT JOIN feature_soil c ON {_ON.replace("x.", "c.")} LEFT JOIN feature_cover d ON {_ON.replace("x.", "d.")}"""


@query("j13_e3_merge_features", "labelled_point", *[f"feature_{f}" for f in FEATURES], oracle=_MERGED_SQL)
def _(spark):
    return jobs.merge_features([spark.table("labelled_point"), *[spark.table(f"feature_{f}") for f in FEATURES]])


@query("j13_merge_stored", "labelled_point", *[f"feature_{f}" for f in FEATURES], oracle=_MERGED_SQL)
def _(spark):
    names = {n: f"{n}_{uuid.uuid4().hex}" for n in ("labelled_point", *[f"feature_{f}" for f in FEATURES])}
    jobs.store_features(spark, {stored: spark.table(n) for n, stored in names.items()}, scratch(spark))
    merged = jobs.merge_stored(spark, list(names.values()))
    for stored in names.values():  # the files stay, under the job's own folder
        spark.sql(f"DROP TABLE {stored}")
    return merged


@query("j14_feature_join", "labelled_point", "feature_veg", oracle=_feature_sql("veg", _quoted("veg")))
def _(spark):
    return jobs.feature_join(spark.table("labelled_point"), spark.table("feature_veg"))


@query(
    "u1_e4_label_union",
    "hotspot",
    "labelled_point",
    oracle="""SELECT fire_id, round(lat_mean, 6) AS lat_mean, round(lon_mean, 6) AS lon_mean, date_first, count, CAST(1 AS INT) AS final FROM fire_sum
UNION ALL SELECT NULL, round(lat, 6), round(lon, 6), CAST(substring(date, 1, 10) AS DATE), NULL, 0 FROM labelled_point WHERE final = 0""",
)
def _(spark):
    others = quality.normalise_date(spark.table("labelled_point").where("final = 0").select("lat", "lon", "date"))
    union = jobs.label_union(fires_of(spark), others)
    return rounded(union.select("fire_id", "lat_mean", "lon_mean", "date_first", "count", "final"), lat_mean=6, lon_mean=6)


def _audit_sql(name: str) -> str:
    columns = ("lat", "lon", "date", *_COLUMNS[name])
    anything = " OR ".join(f"{c} IS NULL" for c in columns)
    return "\nUNION ALL ".join(
        f"""SELECT '{name}' AS feature, final, '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS rows,
count(*) FILTER ({anything}) AS rows_with_null, round(count(*) FILTER ({anything}) / count(*) * 100, 6) AS pct_rows_with_null
FROM ({_feature_sql(name, _quoted(name))}) GROUP BY final"""
        for c in columns
    )


@query(
    "e4_label_union_by_year",
    "hotspot",
    "labelled_point",
    oracle="""SELECT fire_id, round(lat_mean, 6) AS lat_mean, CAST(date_first AS VARCHAR) AS date_first, count, CAST(1 AS INT) AS final,
CAST(year(date_first) AS INT) AS year FROM fire_sum
UNION ALL SELECT NULL, round(lat, 6), substring(date, 1, 10), NULL, 0, CAST(substring(date, 1, 4) AS INT) FROM labelled_point
WHERE final = 0 AND substring(date, 1, 4) IN ('1997', '2000')""",
)
def _(spark):
    root = scratch(spark)
    others = quality.normalise_date(spark.table("labelled_point").where("final = 0").select("lat", "lon", "date"))
    tables.write_topic(fires_of(spark), root, "fires", "date_first")
    tables.write_topic(others, root, "non_fires")
    jobs.label_union_by_year(spark, root, "fires", "non_fires", "labelled", [1997, 2000, 2024])
    union = spark.read.parquet(f"{root}/labelled")
    return rounded(union.select("fire_id", "lat_mean", "date_first", "count", "final", "year"), lat_mean=6)


@query("a12_null_audit", "labelled_point", "feature_veg", oracle=_audit_sql("veg"))
def _(spark):
    joined = jobs.feature_join(spark.table("labelled_point"), spark.table("feature_veg"))
    out = quality.null_audit(joined).select(F.lit("veg").alias("feature"), "*")
    return rounded(out, pct_rows_with_null=6)


@query(
    "e6_audit",
    "labelled_point",
    *[f"feature_{f}" for f in FEATURES],
    oracle="\nUNION ALL ".join(_audit_sql(f) for f in FEATURES),
)
def _(spark):
    out = jobs.audit(spark.table("labelled_point"), {f: spark.table(f"feature_{f}") for f in FEATURES})
    return rounded(out, pct_rows_with_null=6)


_AUDITED = ("labelled_point", *[f"feature_{f}" for f in FEATURES])


def _audit_of(spark: SparkSession):
    return jobs.null_audit(spark.table("labelled_point"), {f: spark.table(f"feature_{f}") for f in FEATURES})


def _null_rows_sql() -> str:
    """Every joined row with a NULL, its burned area and the names of its columns without a value."""
    return "\nUNION ALL ".join(
        f"""SELECT '{f}' AS feature, CAST(l.final AS INT) AS final, l.lat, l.lon, CAST(substring(l.date, 1, 10) AS DATE) AS date, l.area_ha,
concat_ws(',', {", ".join(f"CASE WHEN x.{c} IS NULL THEN '{c}' END" for c in _COLUMNS[f])}) AS missing
FROM labelled_point l JOIN feature_{f} x ON {_ON} WHERE {" OR ".join(f"x.{c} IS NULL" for c in _COLUMNS[f])}"""
        for f in FEATURES
    )


@query("e6_audit_rows", *_AUDITED, oracle=f"SELECT feature, final, lat, lon, date, missing FROM ({_null_rows_sql()})")
def _(spark):
    return _audit_of(spark).rows()


@query(
    "e6_audit_months",
    *_AUDITED,
    oracle=f"""WITH m AS (SELECT CAST(month(CAST(substring(date, 1, 10) AS DATE)) AS INT) AS month, CAST(final AS INT) AS final FROM labelled_point),
k AS (SELECT feature, final, CAST(month(date) AS INT) AS month, count(*) AS n FROM ({_null_rows_sql()}) GROUP BY ALL)
SELECT f.feature, c.final, c.month, t.n AS rows, coalesce(k.n, 0) AS rows_with_null, round(coalesce(k.n, 0) / t.n * 100, 6) AS pct
FROM (SELECT DISTINCT final, month FROM m) c JOIN (SELECT month, count(*) AS n FROM m GROUP BY month) t ON t.month = c.month
JOIN (VALUES {", ".join(f"('{f}')" for f in FEATURES)}) f(feature) ON true
LEFT JOIN k ON k.feature = f.feature AND k.final = c.final AND k.month = c.month""",
)
def _(spark):
    return rounded(_audit_of(spark).by_month(), pct=6)


@query(
    "e6_audit_areas",
    *_AUDITED,
    oracle=f"""WITH v AS (SELECT feature, area_ha AS v FROM ({_null_rows_sql()}) WHERE final = 1 AND area_ha IS NOT NULL),
s AS (SELECT feature, min(v) - CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS lo, max(v) + CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS hi FROM v GROUP BY feature),
h AS (SELECT v.feature, CAST(least(floor((v - lo) / (hi - lo) * 15) + 1, 15) AS INT) AS bin, count(*) AS n FROM v JOIN s ON s.feature = v.feature GROUP BY ALL)
SELECT s.feature, CAST(b AS INT) AS bin, coalesce(n, 0) AS n FROM s CROSS JOIN range(1, 16) r(b) LEFT JOIN h ON h.feature = s.feature AND h.bin = b""",
)
def _(spark):
    return _audit_of(spark).areas().select("feature", "bin", "n")


@query(
    "e6_audit_overlap",
    *_AUDITED,
    oracle=f"""SELECT final, CAST(month(date) AS INT) AS month, features, count(*) AS points FROM
(SELECT final, lat, lon, date, string_agg(DISTINCT feature, ',' ORDER BY feature) AS features FROM ({_null_rows_sql()}) GROUP BY ALL) GROUP BY ALL""",
)
def _(spark):
    return _audit_of(spark).overlap()


@query(
    "p15_rows_with_null",
    "labelled_point",
    "feature_veg",
    oracle=f"""SELECT * FROM ({_feature_sql("veg", _quoted("veg"))}) WHERE final = 1 AND (NDVI IS NULL OR NDWI IS NULL)""",
)
def _(spark):
    return quality.rows_with_null(jobs.feature_join(spark.table("labelled_point"), spark.table("feature_veg")), final=1)


_POINT_COLUMNS = ("point_id", "lat", "lon", "date", "final", "area_ha")


@query(
    "a13_completeness",
    "labelled_point",
    oracle="\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(*) AS rows, count(*) * 6 AS cells,
{" + ".join(f"count({k})" for k in _POINT_COLUMNS)} AS non_null_total,
round(({" + ".join(f"count({k})" for k in _POINT_COLUMNS)}) / (count(*) * 6) * 100, 6) AS pct_total FROM labelled_point"""
        for c in _POINT_COLUMNS
    ),
)
def _(spark):
    return rounded(quality.completeness(spark.table("labelled_point")), pct_total=6)


_DESCRIBED = (("labelled_point", "area_ha"), ("labelled_point", "lat"), ("labelled_point", "lon"))


@query(
    "a14_describe",
    "labelled_point",
    oracle="\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS std, round(min({c}), 7) AS min,
round(quantile_cont({c}, 0.25), 7) AS p25, round(quantile_cont({c}, 0.5), 7) AS p50, round(quantile_cont({c}, 0.75), 7) AS p75,
round(max({c}), 7) AS max FROM {t}"""
        for t, c in _DESCRIBED
    ),
)
def _(spark):
    out = quality.describe(spark.table("labelled_point"), [c for _, c in _DESCRIBED])
    return rounded(out, **{c: 7 for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})


@query(
    "a15_value_shares",
    "feature_cover",
    "labelled_point",
    oracle="""SELECT 'vegetacion2' AS "column", vegetacion2 AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM feature_cover), 9) AS share
FROM feature_cover GROUP BY vegetacion2
UNION ALL SELECT 'date', date, count(*), round(count(*) / (SELECT count(*) FROM feature_cover), 9) FROM feature_cover GROUP BY date""",
)
def _(spark):
    return rounded(quality.value_shares(spark.table("feature_cover")), share=9)


@query(
    "a16_n_unique",
    "feature_cover",
    oracle="""SELECT 'vegetacion2' AS "column", count(DISTINCT vegetacion2) AS n_unique FROM feature_cover
UNION ALL SELECT 'date', count(DISTINCT date) FROM feature_cover""",
)
def _(spark):
    return quality.n_unique(spark.table("feature_cover"))


@query(
    "a17_monthly_nulls",
    "labelled_point",
    "feature_veg",
    oracle=f"""SELECT m.month, m.n AS rows, coalesce(k.n, 0) AS rows_with_null, round(coalesce(k.n, 0) / m.n * 100, 6) AS pct FROM
(SELECT CAST(month(CAST(substring(date, 1, 10) AS DATE)) AS INT) AS month, count(*) AS n FROM labelled_point GROUP BY ALL) m LEFT JOIN
(SELECT CAST(month(date) AS INT) AS month, count(*) AS n FROM ({_feature_sql("veg", _quoted("veg"))})
WHERE final = 0 AND (NDVI IS NULL OR NDWI IS NULL) GROUP BY ALL) k ON k.month = m.month""",
)
def _(spark):
    labels = quality.normalise_date(spark.table("labelled_point"))
    joined = jobs.feature_join(spark.table("labelled_point"), spark.table("feature_veg"))
    return rounded(quality.monthly_nulls(labels, quality.rows_with_null(joined, final=0)), pct=6)


def _histogram_sql(value: str, table: str, bins: int) -> str:
    return f"""SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n FROM range(1, {bins} + 1) r(b) LEFT JOIN
(SELECT CAST(least(floor((v - lo) / (hi - lo) * {bins}) + 1, {bins}) AS INT) AS bin, count(*) AS n
FROM (SELECT {value} AS v FROM {table}) CROSS JOIN (SELECT min({value}) AS lo, max({value}) AS hi FROM {table}) WHERE v IS NOT NULL GROUP BY ALL)
h ON h.bin = b"""


@query("a18_histogram_area", "labelled_point", oracle=_histogram_sql("area_ha", "labelled_point", 15))
def _(spark):
    return quality.histogram(spark.table("labelled_point"), "area_ha", 15).select("bin", "n")


@query(
    "a18_histogram_month",
    "labelled_point",
    oracle=_histogram_sql("CAST(month(CAST(substring(date, 1, 10) AS DATE)) AS DOUBLE)", "labelled_point", 12),
)
def _(spark):
    months = quality.normalise_date(spark.table("labelled_point")).select(F.month("date").alias("month"))
    return quality.histogram(months, "month", 12).select("bin", "n")


@query(
    "u3_null_keys_union",
    "feature_veg",
    "feature_slope",
    oracle="""SELECT lat, lon, date FROM feature_veg WHERE NDVI IS NULL OR NDWI IS NULL
UNION SELECT lat, lon, date FROM feature_slope WHERE grados IS NULL""",
)
def _(spark):
    return quality.null_keys_union(spark.table("feature_veg"), spark.table("feature_slope"), jobs.KEY)


@query(
    "p14_drop_unusable_cover",
    "feature_cover",
    oracle="""SELECT lat, lon, date, vegetacion2 FROM feature_cover WHERE lower(trim(vegetacion2)) NOT IN ('otro', 'sin datos')""",
)
def _(spark):
    return quality.drop_unusable_cover(spark.table("feature_cover"))


@query(
    "e7_clean_cover",
    "feature_cover",
    "cover_legend",
    oracle=f"""SELECT lat, lon, date, vegetacion2 FROM feature_cover WHERE lower(trim(vegetacion2)) NOT IN ('otro', 'sin datos')
AND NOT EXISTS (SELECT 1 FROM cover_legend WHERE code IN ({WATER_LIST}) AND label = vegetacion2)""",
)
def _(spark):
    return jobs.clean_cover(spark.table("feature_cover"), spark.table("cover_legend")).select("lat", "lon", "date", "vegetacion2")


_PROFILED_SQL = f"""SELECT l.point_id, l.lat, l.lon, l.date, l.final, l.area_ha, a.NDVI, a.NDWI, b.elevacion_centro, b.grados, c.vegetacion2 FROM labelled_point l
LEFT JOIN feature_veg a ON {_ON.replace("x.", "a.")} LEFT JOIN feature_slope b ON {_ON.replace("x.", "b.")}
LEFT JOIN feature_cover c ON {_ON.replace("x.", "c.")}"""
_PROFILED = ("labelled_point", "feature_veg", "feature_slope", "feature_cover")
_NUMBERS = ("lat", "lon", "area_ha", "NDVI", "NDWI", "elevacion_centro", "grados")


def _profile_part(spark: SparkSession, part: str) -> DataFrame:
    merged = jobs.merge_features([spark.table(t) for t in _PROFILED])
    return jobs.profile(settle(merged, "merged"))[part]


@query(
    "e8_profile_completeness",
    "labelled_point",
    "feature_veg",
    "feature_slope",
    oracle=f"""WITH m AS (SELECT l.point_id, l.lat, l.lon, l.date, l.final, l.area_ha, a.NDVI, a.NDWI, b.elevacion_centro, b.grados FROM labelled_point l
LEFT JOIN feature_veg a ON {_ON.replace("x.", "a.")} LEFT JOIN feature_slope b ON {_ON.replace("x.", "b.")})
"""
    + "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(*) AS rows FROM m"""
        for c in (*_POINT_COLUMNS, "NDVI", "NDWI", "elevacion_centro", "grados")
    ),
)
def _(spark):
    merged = jobs.merge_features([spark.table("labelled_point"), spark.table("feature_veg"), spark.table("feature_slope")])
    return jobs.profile(settle(merged, "merged"))["completeness"].select("column", "non_null", "rows")


@query(
    "e8_profile_describe",
    *_PROFILED,
    oracle=f"WITH m AS ({_PROFILED_SQL})\n"
    + "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM m"""
        for c in _NUMBERS
    ),
)
def _(spark):
    out = _profile_part(spark, "describe").where(F.col("column").isin(*_NUMBERS))
    return rounded(out, **{c: 6 for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})


@query(
    "e8_profile_value_shares",
    *_PROFILED,
    oracle=f"""WITH m AS ({_PROFILED_SQL})
SELECT 'vegetacion2' AS "column", vegetacion2 AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM m), 9) AS share FROM m GROUP BY vegetacion2""",
)
def _(spark):
    return rounded(_profile_part(spark, "value_shares"), share=9)


@query(
    "e8_profile_n_unique",
    *_PROFILED,
    oracle=f"""WITH m AS ({_PROFILED_SQL}) SELECT 'vegetacion2' AS "column", count(DISTINCT vegetacion2) AS n_unique FROM m""",
)
def _(spark):
    return _profile_part(spark, "n_unique")


@query(
    "e8_profile_head",
    *_PROFILED,
    oracle=f"""WITH m AS ({_PROFILED_SQL}) SELECT lat, lon, CAST(substring(date, 1, 10) AS DATE) AS date, point_id FROM m ORDER BY lat, lon, date, point_id LIMIT 10""",
)
def _(spark):
    merged = settle(jobs.merge_features([spark.table(t) for t in _PROFILED]), "merged")
    return jobs.profile(merged, order=(*jobs.KEY, "point_id"))["head"].select("lat", "lon", "date", "point_id")
