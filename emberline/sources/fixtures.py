"""Input tables derived by SQL from the driver's tables; the same text runs in Spark SQL and in DuckDB."""

from pyspark.sql import SparkSession

BASE = ("nation", "region", "events", "orders")

FIXTURES = {
    "hotspot": """
WITH n AS (SELECT CAST(floor(count(*) / 17) AS BIGINT) AS ns FROM events),
r AS (
  SELECT event_id AS ord, event_id, ts, event_type, value FROM events
  UNION ALL
  SELECT event_id + 1000000000 AS ord, event_id, ts, event_type, value * 3 AS value FROM events WHERE event_id % 50 = 0),
b AS (SELECT r.*, event_id % ns AS site, CAST(floor(event_id / ns) AS BIGINT) AS k FROM r CROSS JOIN n)
SELECT ord,
  CAST(360000 + CAST(floor(site / 80) AS BIGINT) * 2500 + ((k * 7919) % 401 - 200) AS DOUBLE) / 10000 AS latitude,
  CAST(-90000 + (site % 80) * 5000 + ((k * 104729) % 401 - 200) * (CASE WHEN site % 5 = 0 THEN 8 ELSE 1 END) AS DOUBLE) / 10000 AS longitude,
  CAST(ts AS DATE) AS acq_date,
  CASE event_type WHEN 'error' THEN 'l' WHEN 'purchase' THEN 'h' WHEN 'signup' THEN NULL ELSE 'n' END AS confidence,
  CAST(value AS DOUBLE) AS frp
FROM b
""",
    "region_vertex": """
WITH z AS (SELECT n_nationkey AS z, CAST(-950 + n_nationkey * 375 AS DOUBLE) / 100 AS x0,
  CAST(-605 + n_nationkey * 375 AS DOUBLE) / 100 AS x1 FROM nation WHERE n_nationkey < 11),
s AS (SELECT 0 AS seq UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4)
SELECT CASE WHEN z < 10 THEN 'R0' ELSE 'R' END || CAST(z AS STRING) AS region, 0 AS part, seq,
  CASE WHEN seq IN (0, 4) THEN x0 WHEN seq IN (1, 2) THEN x1 ELSE (x0 + x1) / 2 END AS x,
  CASE WHEN seq < 2 THEN CAST(355 AS DOUBLE) / 10
       WHEN seq = 3 THEN CAST(CASE WHEN z = 3 THEN 365 ELSE 555 END AS DOUBLE) / 10
       ELSE CAST(45 + z AS DOUBLE) END AS y
FROM z CROSS JOIN s
""",
    "country_vertex": """
WITH s AS (SELECT 0 AS seq UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)
SELECT n_name AS country, r_name AS continent, seq,
  CAST(-10 + (n_nationkey % 5) * 8 + CASE WHEN seq IN (1, 2) THEN 8 ELSE 0 END AS DOUBLE) AS x,
  CAST(35 + CAST(floor(n_nationkey / 5) AS BIGINT) * 4 + CASE WHEN seq >= 2 THEN 4 ELSE 0 END AS DOUBLE) AS y
FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN s
""",
    "land_cover_cell": """
WITH c AS (SELECT CAST(floor(id / 820) AS INT) AS row, CAST(id % 820 AS INT) AS col FROM range(344400) t(id))
SELECT row, col, CAST(CASE WHEN row BETWEEN 370 AND 385 AND col BETWEEN 100 AND 115 THEN -1
  WHEN (row * 31 + col * 17) % 97 < 3 THEN -1 ELSE (row * 7 + col * 13) % 45 END AS DOUBLE) AS value FROM c
""",
    "soil_cell": """
WITH c AS (SELECT CAST(floor(id / 820) AS INT) AS row, CAST(id % 820 AS INT) AS col FROM range(344400) t(id))
SELECT row, col, CASE WHEN (row * 13 + col * 29) % 89 < 20 THEN CAST(-9999 AS DOUBLE)
  ELSE CAST((row * 17 + col * 7) % 1200 AS DOUBLE) / 10 END AS value FROM c
""",
    "dem_cell": """
WITH c AS (SELECT CAST(floor(id / 820) AS INT) AS row, CAST(id % 820 AS INT) AS col FROM range(344400) t(id))
SELECT row, col, CASE WHEN (row * 31 + col) % 97 = 0 THEN CAST(-9999 AS DOUBLE) WHEN (row * 13 + col) % 53 = 0 THEN CAST(-1 AS DOUBLE)
  ELSE CAST(((row - 200) * (row - 200) + 3 * col) % 1500 AS DOUBLE) END AS value FROM c
""",
    "cover_legend": """
SELECT CAST(id AS INT) AS code, CASE id WHEN 20 THEN ' Otro ' WHEN 44 THEN 'Sin datos'
  ELSE 'cover_' || CAST(id AS STRING) END AS label FROM range(45) t(id)
""",
    "weather_daily": """
WITH p AS (SELECT DISTINCT CAST(floor((56 - latitude) * 20) AS INT) AS row, CAST(floor((longitude + 10) * 20) AS INT) AS col,
  acq_date AS date FROM hotspot)
SELECT row, col, date,
  CAST((row * 3 + col) % 300 AS DOUBLE) / 10 AS temp_mean, CAST((row * 3 + col) % 300 + 60 AS DOUBLE) / 10 AS temp_max,
  CAST((row * 3 + col) % 300 - 60 AS DOUBLE) / 10 AS temp_min, CAST((row + col * 7) % 100 AS DOUBLE) AS humidity_mean,
  CAST((row * col) % 200 AS DOUBLE) / 10 AS precipitation, CAST((row + col) % 90 AS DOUBLE) AS wind_speed_max,
  CAST((row + col) % 90 + 20 AS DOUBLE) AS wind_gusts_max, CAST(9000 + (row * 11 + col) % 1300 AS DOUBLE) / 10 AS pressure_mean,
  CAST((row * 5 + col * 3) % 101 AS DOUBLE) AS cloud_cover, CAST((row * 2 + col) % 300 AS DOUBLE) / 10 AS radiation,
  CAST((row + col * 2) % 80 AS DOUBLE) / 10 AS evapotranspiration, CAST((row * 97 + col * 89) % 50000 AS DOUBLE) AS sunshine_seconds
FROM p WHERE (row + col) % 8 <> 0
""",
    "s2_scene": """
SELECT ord AS scene_id, CAST(floor((56 - latitude) * 20) AS INT) AS row, CAST(floor((longitude + 10) * 20) AS INT) AS col,
  acq_date - CAST(ord % 45 AS INT) AS obs_date, CAST(300 + (ord * 13) % 700 AS DOUBLE) AS b3,
  CAST(CASE WHEN ord % 101 = 0 THEN 0 ELSE 200 + (ord * 29) % 900 END AS DOUBLE) AS b4,
  CAST(CASE WHEN ord % 101 = 0 THEN 0 ELSE 800 + (ord * 41) % 2500 END AS DOUBLE) AS b8
FROM hotspot WHERE ord < 1000000000
""",
    "s2_cloud": """
SELECT ord AS scene_id, CAST((ord * 37) % 100 AS DOUBLE) / 100 AS cs_cdf FROM hotspot WHERE ord < 1000000000 AND ord % 23 <> 0
""",
    "labelled_point": """
SELECT o_orderkey AS point_id, CAST(360000 + (o_orderkey * 37) % 180000 AS DOUBLE) / 10000 AS lat,
  CAST(-90000 + (o_orderkey * 53) % 390000 AS DOUBLE) / 10000 AS lon,
  CAST(CAST(o_orderdate AS DATE) AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN ' 00:00:00' ELSE '' END AS date,
  CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS final,
  CASE WHEN o_orderkey % 31 = 0 THEN o_totalprice / 100 END AS area_ha
FROM orders
""",
    "feature_veg": """
SELECT lat, lon, substring(date, 1, 10) AS date,
  CASE WHEN (point_id % 17 = 0) OR (point_id % 3 = 0 AND substring(date, 6, 2) IN ('12', '01')) THEN NULL
       ELSE CAST(point_id % 2000 - 1000 AS DOUBLE) / 1000 END AS NDVI,
  CASE WHEN point_id % 17 = 0 THEN NULL ELSE CAST((point_id * 7) % 2000 - 1000 AS DOUBLE) / 1000 END AS NDWI
FROM labelled_point WHERE point_id % 19 <> 0
""",
    "feature_slope": """
SELECT lat, lon, substring(date, 1, 10) AS date, CAST(point_id % 2500 AS DOUBLE) AS elevacion_centro,
  CASE WHEN point_id % 9 = 0 THEN NULL ELSE CAST(point_id % 450 AS DOUBLE) / 10 END AS grados
FROM labelled_point
""",
    "feature_soil": """
SELECT lat, lon, date, CASE WHEN final = 1 AND point_id % 2 = 0 THEN NULL WHEN final = 0 AND point_id % 4 = 0 THEN NULL
  ELSE CAST(point_id % 1200 AS DOUBLE) / 10 END AS SOC FROM labelled_point
""",
    "feature_cover": """
SELECT lat, lon, date, CASE WHEN point_id % 41 = 0 THEN 'SIN DATOS ' WHEN point_id % 43 = 0 THEN 'otro'
  ELSE 'cover_' || CAST(point_id % 45 AS STRING) END AS vegetacion2 FROM labelled_point
""",
}

# What each fixture reads besides the driver's tables.
NEEDS = {
    "weather_daily": ("hotspot",),
    "s2_scene": ("hotspot",),
    "s2_cloud": ("hotspot",),
    "feature_veg": ("labelled_point",),
    "feature_slope": ("labelled_point",),
    "feature_soil": ("labelled_point",),
    "feature_cover": ("labelled_point",),
}


def closure(names: tuple[str, ...]) -> list[str]:
    """``names`` and what they need, in an order in which each can be built."""
    out: list[str] = []
    for name in names:
        for need in (*NEEDS.get(name, ()), name):
            if need not in out:
                out.append(need)
    return out


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views over the driver's tables and the fixtures ``names``."""
    for table in BASE:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    for name in closure(names):
        spark.sql(FIXTURES[name]).createOrReplaceTempView(name)


def with_clause(*names: str) -> str:
    """The same fixtures as the beginning of a ``WITH`` list, each with its trailing comma."""
    return "".join(f"{name} AS ({FIXTURES[name].strip()}),\n" for name in closure(names))
