"""Geometry as closed-form Column expressions; everything stays in generated JVM code."""

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
METRES_PER_DEGREE = 111320.0

WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
GRS80_F = 1 / 298.257222101


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s_lat = F.sin((p2 - p1) / 2)
    s_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = s_lat * s_lat + F.cos(p1) * F.cos(p2) * s_lon * s_lon
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * EARTH_RADIUS_KM)


def chord(eps_km: float) -> float:
    """Straight-line length, on the unit sphere, of an arc of ``eps_km``."""
    return 2 * math.sin(eps_km / (2 * EARTH_RADIUS_KM))


def unit_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    p, l = F.radians(lat), F.radians(lon)
    return F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)


def _authalic_q(sin_phi: Column, e: float) -> Column:
    es = sin_phi * e
    return (sin_phi / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * e)) * (1 - e * e)


def _authalic_q_of(phi: float, e: float) -> float:
    s = math.sin(phi)
    return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


def _latitude_terms(e: float, terms: int = 5, points: int = 16) -> list[float]:
    """Sine coefficients of geodetic minus authalic latitude in multiples of twice the authalic latitude.

    The difference is smooth and odd, so a sine sum over a few latitudes gives them to rounding.
    """
    qp = _authalic_q_of(math.pi / 2, e)
    betas = [math.pi * (j + 0.5) / (2 * points) for j in range(points)]
    excess = []
    for beta in betas:
        low, high = 0.0, math.pi / 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if _authalic_q_of(mid, e) < qp * math.sin(beta) else (low, mid)
        excess.append((low + high) / 2 - beta)
    return [2 / points * sum(d * math.sin(2 * k * b) for d, b in zip(excess, betas)) for k in range(1, terms + 1)]


def _geodetic(sin_beta: Column, e: float) -> Column:
    """Latitude in degrees from the sine of the authalic latitude."""
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin_beta)))
    phi = beta
    for k, c in enumerate(_latitude_terms(e), 1):
        phi = phi + F.sin(beta * (2 * k)) * c
    return F.degrees(phi)


def _cylinder() -> tuple[float, float]:
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    ts = math.radians(30)
    return e, math.cos(ts) / math.sqrt(1 - (e * math.sin(ts)) ** 2)


def _azimuthal() -> tuple[float, float, float, float, float]:
    e = math.sqrt(GRS80_F * (2 - GRS80_F))
    phi0, lam0 = math.radians(52), math.radians(10)
    qp, q0 = _authalic_q_of(math.pi / 2, e), _authalic_q_of(phi0, e)
    beta0 = math.asin(q0 / qp)
    rq = WGS84_A * math.sqrt(qp / 2)
    d = WGS84_A * math.cos(phi0) / math.sqrt(1 - (e * math.sin(phi0)) ** 2) / (rq * math.cos(beta0))
    return e, lam0, beta0, rq, d


#: Eccentricity and scale; eccentricity, central meridian, authalic latitude of the centre, radius and stretch.
_CYLINDER, _AZIMUTHAL = _cylinder(), _azimuthal()


def to_6933(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Global cylindrical equal-area metres (true scale at 30 degrees)."""
    e, k0 = _CYLINDER
    x = F.radians(lon) * (WGS84_A * k0)
    y = _authalic_q(F.sin(F.radians(lat)), e) * (WGS84_A / (2 * k0))
    return x, y


def from_6933(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of ``to_6933``."""
    e, k0 = _CYLINDER
    return F.degrees(x / (WGS84_A * k0)), _geodetic(y * (2 * k0 / WGS84_A / _authalic_q_of(math.pi / 2, e)), e)


def to_3035(lon: Column, lat: Column) -> tuple[Column, Column]:
    """European Lambert azimuthal equal-area metres (centre 52N 10E)."""
    e, lam0, beta0, rq, d = _AZIMUTHAL
    qp = _authalic_q_of(math.pi / 2, e)
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _authalic_q(F.sin(F.radians(lat)), e) / qp)))
    dl = F.radians(lon) - lam0
    b = F.sqrt(2.0 / (1.0 + F.sin(beta) * math.sin(beta0) + F.cos(beta) * F.cos(dl) * math.cos(beta0))) * rq
    x = b * d * F.cos(beta) * F.sin(dl) + 4321000.0
    y = (b / d) * (F.sin(beta) * math.cos(beta0) - F.cos(beta) * F.cos(dl) * math.sin(beta0)) + 3210000.0
    return x, y


def from_3035(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of ``to_3035``; the centre needs no case of its own, as nothing is divided by the distance to it."""
    e, lam0, beta0, rq, d = _AZIMUTHAL
    east, north = (x - 4321000.0) / d, (y - 3210000.0) * d
    half = (east * east + north * north) / (4 * rq * rq)  # squared sine of half the angle to the centre
    s, c = F.sqrt(F.greatest(F.lit(0.0), 1 - half)) / rq, 1 - 2 * half
    lam = F.atan2(east * s, c * math.cos(beta0) - north * s * math.sin(beta0)) + lam0
    return F.degrees(lam), _geodetic(c * math.sin(beta0) + north * s * math.cos(beta0), e)


PROJECTIONS = {"EPSG:4326": lambda lon, lat: (lon, lat), "EPSG:6933": to_6933, "EPSG:3035": to_3035}
UNPROJECTIONS = {"EPSG:4326": lambda x, y: (x, y), "EPSG:6933": from_6933, "EPSG:3035": from_3035}


def ring_to_4326(ring: Column, crs: str) -> Column:
    """A ring in longitude and latitude."""
    if crs not in UNPROJECTIONS:
        raise ValueError(f"unknown projection {crs}")

    def vertex(v: Column) -> Column:
        lon, lat = UNPROJECTIONS[crs](v["x"], v["y"])
        return F.struct(lon.alias("x"), lat.alias("y"))

    return ring if crs == "EPSG:4326" else F.transform(ring, vertex)


@dataclass(frozen=True)
class RasterMeta:
    """North-up pixel grid: upper-left corner, pixel size, shape, nodata value and CRS."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int
    nodata: float
    crs: str = "EPSG:4326"


def pixel_of(lat: Column, lon: Column, meta: RasterMeta) -> tuple[Column, Column]:
    """(row, col) of the pixel that holds a point; may lie outside the grid."""
    x, y = PROJECTIONS[meta.crs](lon, lat)
    row = F.floor((F.lit(meta.y0) - y) * (1 / meta.dy)).cast("int")
    col = F.floor((x - meta.x0) * (1 / meta.dx)).cast("int")
    return row, col


def destination(lat: Column, lon: Column, dist_m: Column, bearing_deg: Column, compat_degrees: bool = False):
    """Point at a small distance and bearing, on a locally flat Earth.

    ``compat_degrees`` feeds degrees to the radian functions, for tables made with that formula.
    """
    to_angle = (lambda c: c) if compat_degrees else F.radians
    theta = to_angle(bearing_deg)
    dlat = dist_m * F.cos(theta) / METRES_PER_DEGREE
    dlon = dist_m * F.sin(theta) / (F.cos(to_angle(lat)) * METRES_PER_DEGREE)
    return lat + dlat, lon + dlon


def _edges(ring: Column) -> Column:
    """Pairs of consecutive vertices of an open or closed ring, the closing edge included."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_edges(ring: Column) -> Column:
    """``ARRAY<STRUCT<a, b>>`` of a ring's edges."""
    return F.when(F.size(ring) > 0, _edges(ring))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area: positive if the ring runs anticlockwise."""
    twice = F.aggregate(
        _edges(ring), F.lit(0.0), lambda acc, e: acc + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    )
    return twice / 2


def ring_perimeter(ring: Column) -> Column:
    return F.aggregate(
        _edges(ring),
        F.lit(0.0),
        lambda acc, e: acc + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]),
    )


def crosses_right(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Does an edge cross the ray from (px, py) towards +x? Half-open in y, so a vertex counts once."""
    return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)


def point_in_edges(px: Column, py: Column, edges: Column) -> Column:
    """Even-odd containment in an ``ARRAY<STRUCT<x1, y1, x2, y2>>``."""
    crossing = lambda e: (e["y1"] != e["y2"]) & crosses_right(
        px, py, e["x1"], e["y1"], e["x2"], F.when(e["y1"] == e["y2"], e["y1"] + 1.0).otherwise(e["y2"])
    )
    return F.aggregate(edges, F.lit(False), lambda acc, e: acc != crossing(e))


def point_in_ring(px: Column, py: Column, ring: Column) -> Column:
    edges = F.transform(
        _edges(ring),
        lambda e: F.struct(
            e["a"]["x"].alias("x1"), e["a"]["y"].alias("y1"), e["b"]["x"].alias("x2"), e["b"]["y"].alias("y2")
        ),
    )
    return point_in_edges(px, py, edges)


def buffered_area(area: Column, perimeter: Column, radius: float) -> Column:
    """Area of a convex shape grown by ``radius`` on all sides (a point or a segment included)."""
    return area + perimeter * radius + math.pi * radius * radius
