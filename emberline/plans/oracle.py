"""The same computations as plain SQL over the driver's tables, for checking.

``BLOCKS`` are common table expressions; ``sql(select)`` puts the ones a statement needs in front of it.
"""

import math
import re

from emberline.functions.geo import GRS80_F, WGS84_A, WGS84_F
from emberline.operators.raster import UNUSABLE_COVER, WATER_URBAN_COVER
from emberline.schema import WEATHER_COLUMNS
from emberline.sources.fixtures import FIXTURES


def _haversine(a: str, b: str) -> str:
    return (
        f"2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + "
        f"cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"
    )


def _q(s: str, e: float) -> str:
    return f"(1 - {e * e!r}) * ({s} / (1 - pow({s} * {e!r}, 2)) - ln((1 - {s} * {e!r}) / (1 + {s} * {e!r})) / (2 * {e!r}))"


def _xy_6933(lon: str, lat: str) -> tuple[str, str]:
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    k0 = math.cos(math.radians(30)) / math.sqrt(1 - (e * math.sin(math.radians(30))) ** 2)
    return f"radians({lon}) * {WGS84_A * k0!r}", f"({_q(f'sin(radians({lat}))', e)}) * {WGS84_A / (2 * k0)!r}"


def _xy_3035(lon: str, lat: str) -> tuple[str, str]:
    e = math.sqrt(GRS80_F * (2 - GRS80_F))

    def q(p):
        s = math.sin(p)
        return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    p0, qp = math.radians(52), q(math.pi / 2)
    b0, rq = math.asin(q(p0) / qp), WGS84_A * math.sqrt(qp / 2)
    d = WGS84_A * math.cos(p0) / math.sqrt(1 - (e * math.sin(p0)) ** 2) / (rq * math.cos(b0))
    beta = f"asin(({_q(f'sin(radians({lat}))', e)}) / {qp!r})"
    dl = f"(radians({lon}) - {math.radians(10)!r})"
    k = f"{rq!r} * sqrt(2 / (1 + {math.sin(b0)!r} * sin({beta}) + {math.cos(b0)!r} * cos({beta}) * cos({dl})))"
    return (
        f"{k} * {d!r} * cos({beta}) * sin({dl})",
        f"{k} / {d!r} * ({math.cos(b0)!r} * sin({beta}) - {math.sin(b0)!r} * cos({beta}) * cos({dl}))",
    )


def uniform(slot: int, *key: str) -> str:
    text = " || '|' || ".join(["'42'", *key])
    return f"(('0x' || substr(md5({text}), {1 + 8 * slot}, 8))::BIGINT / 4294967296.0)"


def pixel(lat: str, lon: str) -> str:
    return f"CAST(floor((56 - {lat}) * 20) AS INT) AS row, CAST(floor(({lon} + 10) * 20) AS INT) AS col"


def crossing(x: str, y: str) -> str:
    return f"((y1 > {y}) <> (y2 > {y})) AND {x} < (x2 - x1) * ({y} - y1) / (y2 - y1) + x1"


def filled(need: str) -> str:
    """row, col, value of the pixels of ``need``, invalid ones filled with the mode of their 5 x 5 window."""
    return f"""
WITH centre AS (SELECT DISTINCT n.row, n.col, c.value FROM {need} n JOIN land_cover_cell c ON c.row = n.row AND c.col = n.col),
votes AS (SELECT b.row, b.col, c.value, count(*) AS n FROM centre b JOIN land_cover_cell c
  ON c.row BETWEEN b.row - 2 AND b.row + 2 AND c.col BETWEEN b.col - 2 AND b.col + 2
  WHERE b.value < 0 AND c.value >= 0 GROUP BY b.row, b.col, c.value)
SELECT row, col, value FROM centre WHERE value >= 0
UNION ALL
SELECT row, col, value FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) AS k FROM votes) WHERE k = 1"""


_X6933, _Y6933 = _xy_6933("lon_r", "lat_r")
XA, YA = _xy_3035("x1", "y1")
XB, YB = _xy_3035("x2", "y2")
_UNUSABLE = ", ".join(map(str, UNUSABLE_COVER))

BLOCKS = dict(FIXTURES)
BLOCKS.update(
    {
        "clean_point": """
SELECT ord, latitude AS lat, longitude AS lon, frp, acq_date AS date FROM (
  SELECT *, row_number() OVER (PARTITION BY latitude, longitude, acq_date ORDER BY ord) AS rn
  FROM hotspot WHERE confidence IS DISTINCT FROM 'l') WHERE rn = 1 AND frp > 50""",
        "near_pair": f"""
SELECT a.ord AS a, b.ord AS b FROM clean_point a JOIN clean_point b ON b.lat BETWEEN a.lat - 0.046 AND a.lat + 0.046
WHERE {_haversine("a", "b")} <= 5.0""",
        "reached": """
SELECT ord, ord AS root FROM clean_point UNION SELECT p.b, r.root FROM reached r JOIN near_pair p ON p.a = r.ord""",
        "fire_component": """
SELECT ord, first_ord, dense_rank() OVER (ORDER BY first_ord) - 1 AS label
FROM (SELECT ord, min(root) AS first_ord FROM reached GROUP BY ord)""",
        "gap_row": """
SELECT c.*, label, CASE WHEN date_diff('day', coalesce(lag(date) OVER (PARTITION BY label ORDER BY date, c.ord), DATE '2020-01-01'), date) > 6
  THEN 1 ELSE 0 END AS split FROM clean_point c JOIN fire_component k ON k.ord = c.ord""",
        "fire_point": """
SELECT ord, frp, date, lat, lon, round_even(lat * 100, 0) / 100 AS lat_r, round_even(lon * 100, 0) / 100 AS lon_r,
  CAST(label AS VARCHAR) || coalesce(string_agg(CASE WHEN split = 1 THEN '_' || CAST(ord AS VARCHAR) END, '')
    OVER (PARTITION BY label ORDER BY date, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS fire_id FROM gap_row""",
        "shuffled_gap": """
SELECT c.*, label, CASE WHEN date_diff('day', coalesce(lag(date) OVER (PARTITION BY label ORDER BY c.ord), DATE '2020-01-01'), date) > 6
  THEN 1 ELSE 0 END AS split FROM clean_point c JOIN fire_component k ON k.ord = c.ord""",
        "shuffled_fire_point": """
SELECT ord, frp, date, lat, lon,
  CAST(label AS VARCHAR) || coalesce(string_agg(CASE WHEN split = 1 THEN '_' || CAST(ord AS VARCHAR) END, '')
    OVER (PARTITION BY label ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS fire_id FROM shuffled_gap""",
        "fire_sum": """
SELECT fire_id, CAST(sum(CAST(round_even(lat * 100, 0) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS lat_mean,
  CAST(sum(CAST(round_even(lon * 100, 0) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS lon_mean,
  CAST(sum(CAST(frp AS DECIMAL(20,6))) AS DOUBLE) AS frp_sum,
  CAST(sum(CAST(frp AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS frp_mean, count(*) AS count,
  min(date) AS date_first, max(date) AS date_last, CAST(date_diff('day', min(date), max(date)) + 1 AS INT) AS duration_days
FROM fire_point GROUP BY fire_id""",
        "hull_place": f"SELECT DISTINCT fire_id, {_X6933} AS x, {_Y6933} AS y FROM fire_point",
        "hull_span": """
SELECT p.fire_id, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM hull_place p JOIN hull_place q
ON p.fire_id = q.fire_id AND (p.x <> q.x OR p.y <> q.y)""",
        "hull_edges": """
SELECT * FROM hull_span s WHERE NOT EXISTS (SELECT 1 FROM hull_place r WHERE r.fire_id = s.fire_id AND (
  (qx - px) * (r.y - py) - (qy - py) * (r.x - px) < -0.001
  OR (abs((qx - px) * (r.y - py) - (qy - py) * (r.x - px)) <= 0.001
      AND ((r.x - px) * (qx - px) + (r.y - py) * (qy - py) < 0
           OR (r.x - px) * (qx - px) + (r.y - py) * (qy - py) > (qx - px) * (qx - px) + (qy - py) * (qy - py)))))""",
        "hull_centre": "SELECT fire_id, avg(x) AS cx, avg(y) AS cy FROM hull_place GROUP BY fire_id",
        "fire_hull": """
SELECT e.fire_id, sum((px - cx) * (qy - cy) - (qx - cx) * (py - cy)) / 2 AS area, sum(sqrt(pow(qx - px, 2) + pow(qy - py, 2))) AS perimeter
FROM hull_edges e JOIN hull_centre c ON c.fire_id = e.fire_id GROUP BY e.fire_id""",
        "fire_ha": """
SELECT s.fire_id, round_even((CASE WHEN s.count < 3 THEN s.count * 375.0 * 375.0
  ELSE coalesce(h.area, 0) + coalesce(h.perimeter, 0) * 187.5 + pi() * 187.5 * 187.5 END) / 10000, 2) AS area_ha
FROM fire_sum s LEFT JOIN fire_hull h ON h.fire_id = s.fire_id""",
        "region_edge": """
SELECT region, x AS x1, y AS y1, lead(x, 1, first_x) OVER w AS x2, lead(y, 1, first_y) OVER w AS y2
FROM (SELECT *, first_value(x) OVER v AS first_x, first_value(y) OVER v AS first_y FROM region_vertex
      WINDOW v AS (PARTITION BY region, part ORDER BY seq))
WINDOW w AS (PARTITION BY region, part ORDER BY seq)""",
        "country_edge": """
SELECT country, continent, x AS x1, y AS y1, lead(x, 1, first_x) OVER w AS x2, lead(y, 1, first_y) OVER w AS y2
FROM (SELECT *, first_value(x) OVER v AS first_x, first_value(y) OVER v AS first_y FROM country_vertex
      WINDOW v AS (PARTITION BY country ORDER BY seq))
WINDOW w AS (PARTITION BY country ORDER BY seq)""",
        "fire_region": f"""
SELECT s.*, region FROM fire_sum s JOIN (
  SELECT fire_id, region FROM fire_sum CROSS JOIN region_edge WHERE {crossing("lon_mean", "lat_mean")}
  GROUP BY fire_id, region HAVING count(*) % 2 = 1) r ON r.fire_id = s.fire_id""",
        "region_km2": f"""
SELECT region, abs(sum(({XA}) * ({YB}) - ({XB}) * ({YA}))) / 2e6 AS area_km2 FROM region_edge GROUP BY region""",
        "region_stat": """
SELECT r.region, count(a.fire_id) AS fires, coalesce(CAST(sum(CAST(frp_mean AS DECIMAL(28,10))) AS DOUBLE), 0) AS frp_total
FROM (SELECT DISTINCT region FROM region_edge) r LEFT JOIN fire_region a ON a.region = r.region GROUP BY r.region""",
        "region_quota": """
SELECT s.region, fires, frp_total, area_km2, CAST(round_even((0.5 * (fires / n_fires) + 0.5 * (area_km2 / km2)) * (n_fires * 30), 0) AS BIGINT) AS quota
FROM region_stat s JOIN region_km2 k ON k.region = s.region
CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n_fires FROM fire_sum) CROSS JOIN (SELECT sum(area_km2) AS km2 FROM region_km2)""",
        "near_plan": """
SELECT a.*, CASE WHEN frp_total > 0 THEN CAST(round_even(frp_mean / frp_total * quota, 0) AS BIGINT) ELSE 0 END AS n_near
FROM fire_region a JOIN region_quota q ON q.region = a.region""",
        "near_month": """
SELECT p.*, month, greatest(0, n_near // 12 + CASE WHEN month <= n_near % 12 THEN 1 ELSE 0 END
  - CASE WHEN month = month(date_first) THEN 1 ELSE 0 END) AS n
FROM near_plan p CROSS JOIN (SELECT CAST(range AS INT) AS month FROM range(1, 13)) WHERE n_near > 0""",
        "near_draw": f"""
SELECT *, 5000 + {uniform(0, "'near'", "fire_id", "region", "month", "i")} * 5000 AS dist,
  radians({uniform(1, "'near'", "fire_id", "region", "month", "i")} * 360) AS theta
FROM (SELECT *, unnest(range(n)) AS i FROM near_month WHERE n > 0)""",
        "near_point": """
SELECT 'near:' || region || ':' || fire_id || ':' || month || ':' || i AS point_id, region, 'near' AS source,
  lat_mean + dist * cos(theta) / 111320 AS lat,
  lon_mean + dist * sin(theta) / (cos(radians(lat_mean)) * 111320) AS lon,
  make_date(CAST(year(date_first) AS BIGINT), CAST(month AS BIGINT), CAST(least(28, day(date_first)) AS BIGINT)) AS date FROM near_draw""",
        "near_pixel": f"SELECT *, {pixel('lat', 'lon')} FROM near_point",
        "near_fill": filled("near_pixel"),
        "near_check": f"""
SELECT p.*, f.value IS NOT NULL AND f.value NOT IN ({_UNUSABLE})
  AND NOT EXISTS (SELECT 1 FROM fire_sum s WHERE s.lat_mean = p.lat AND s.lon_mean = p.lon) AS valid
FROM near_pixel p LEFT JOIN near_fill f ON f.row = p.row AND f.col = p.col""",
        "region_box": """
SELECT region, greatest(min(x1), -10) AS min_x, least(max(x1), 30) AS max_x, greatest(min(y1), 35) AS min_y, least(max(y1), 71) AS max_y
FROM region_edge GROUP BY region""",
        "random_plan": """
SELECT b.*, CAST(ceil(rest / 12) AS BIGINT) AS n FROM region_box b JOIN (
  SELECT q.region, q.quota - coalesce(planned, 0) + coalesce(rejected, 0) AS rest FROM region_quota q
  LEFT JOIN (SELECT region, sum(n_near) AS planned FROM near_plan GROUP BY region) p ON p.region = q.region
  LEFT JOIN (SELECT region, count(*) AS rejected FROM near_check WHERE NOT valid GROUP BY region) r ON r.region = q.region
) t ON t.region = b.region WHERE rest > 0 AND min_x <= max_x AND min_y <= max_y""",
        "random_try": f"""
SELECT 'random:' || region || ':' || month || ':' || i AS point_id, region, 'random' AS source, attempt,
  min_y + {uniform(0, "'random'", "region", "month", "i", "attempt")} * (max_y - min_y) AS lat,
  min_x + {uniform(1, "'random'", "region", "month", "i", "attempt")} * (max_x - min_x) AS lon,
  make_date(CAST((SELECT arg_min(year(date_first), (-count, fire_id)) FROM fire_sum) AS BIGINT), CAST(month AS BIGINT),
    CAST(floor({uniform(2, "'random'", "region", "month", "i", "attempt")} * 28) + 1 AS BIGINT)) AS date
FROM (SELECT *, unnest(range(n)) AS i FROM random_plan)
CROSS JOIN (SELECT CAST(range AS INT) AS month FROM range(1, 13)) CROSS JOIN (SELECT CAST(range AS INT) AS attempt FROM range(1, 4))""",
        "random_pixel": f"SELECT *, {pixel('lat', 'lon')} FROM random_try",
        "random_fill": filled("random_pixel"),
        "random_point": f"""
SELECT point_id, region, source, lat, lon, date FROM (
  SELECT p.*, row_number() OVER (PARTITION BY point_id ORDER BY attempt) AS k
  FROM random_pixel p JOIN random_fill f ON f.row = p.row AND f.col = p.col
  WHERE f.value NOT IN ({_UNUSABLE}) AND NOT EXISTS (SELECT 1 FROM fire_sum s WHERE s.lat_mean = p.lat AND s.lon_mean = p.lon)) WHERE k = 1""",
        "synthetic_row": """
SELECT point_id, region, source, lat, lon, date FROM near_check WHERE valid
UNION ALL SELECT point_id, region, source, lat, lon, date FROM random_point""",
        "fire_row": "SELECT s.*, area_ha FROM fire_sum s JOIN fire_ha a ON a.fire_id = s.fire_id",
        "fire_pixel": f"SELECT fire_id, lat_mean AS lat, lon_mean AS lon, date_first AS date, {pixel('lat_mean', 'lon_mean')} FROM fire_sum",
        "fire_fill": filled("fire_pixel"),
        "labelled_row": """
SELECT 'fire:' || fire_id AS point_id, fire_id, lat_mean, lon_mean, frp_sum, count, date_first, area_ha, 1 AS final FROM fire_row
UNION ALL SELECT point_id, NULL, lat, lon, NULL, NULL, date, NULL, 0 FROM synthetic_row""",
        "e2_point": f"""
SELECT *, {pixel('lat_mean', 'lon_mean')}, date_first AS date FROM labelled_row ORDER BY final DESC, count DESC NULLS LAST, point_id""",
        "e2_fill": filled("e2_point"),
    }
)

_WORD = re.compile(r"\b[a-z_0-9]+\b")


def _needs(text: str) -> list[str]:
    return [w for w in dict.fromkeys(_WORD.findall(text)) if w in BLOCKS]


def sql(select: str) -> str:
    """``select`` with the blocks it mentions, directly or not, in front."""
    order: list[str] = []

    def add(name: str, above: tuple[str, ...]) -> None:
        if name in order or name in above:
            return
        for need in _needs(BLOCKS[name]):
            add(need, (*above, name))
        order.append(name)

    for name in _needs(select):
        add(name, ())
    if not order:
        return select
    ctes = []
    for name in order:
        head = "reached(ord, root)" if name == "reached" else name
        ctes.append(f"{head} AS ({BLOCKS[name].strip()})")
    if select.startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + select[5:]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def medians(points: str, key: str) -> str:
    """``key``, NDVI, NDWI of points with row, col, date."""
    return f"""
SELECT p.{key}, median(CASE WHEN b8 + b4 <> 0 THEN (b8 - b4) / (b8 + b4) END) AS NDVI,
  median(CASE WHEN b3 + b8 <> 0 THEN (b3 - b8) / (b3 + b8) END) AS NDWI
FROM {points} p JOIN s2_scene s ON s.row = p.row AND s.col = p.col AND s.obs_date >= p.date - 30 AND s.obs_date < p.date
JOIN s2_cloud c ON c.scene_id = s.scene_id AND cs_cdf >= 0.5 GROUP BY p.{key}"""


def slopes(points: str, key: str) -> str:
    """``key``, elevation and slope of points with row, col."""
    return f"""
WITH known AS (SELECT row, col, value FROM dem_cell WHERE value <> -9999)
SELECT p.{key}, o.value AS elevacion_centro, CASE WHEN o.value IS NOT NULL THEN degrees(atan(sqrt(
  pow((e.value - w.value) / (cos(radians(56 - (p.row + 0.5) * 0.05)) * (2 * 0.05 * 111320)), 2)
  + pow((n.value - s.value) / (2 * 0.05 * 111320), 2)))) END AS grados
FROM {points} p LEFT JOIN known o ON o.row = p.row AND o.col = p.col
LEFT JOIN known n ON n.row = p.row - 1 AND n.col = p.col LEFT JOIN known s ON s.row = p.row + 1 AND s.col = p.col
LEFT JOIN known w ON w.row = p.row AND w.col = p.col - 1 LEFT JOIN known e ON e.row = p.row AND e.col = p.col + 1"""


WEATHER_LIST = ", ".join(WEATHER_COLUMNS)
WATER_LIST = ", ".join(map(str, WATER_URBAN_COVER))
