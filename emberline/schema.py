"""Explicit schemas at the boundaries."""

from pyspark.sql import types as T

_KINDS = {"LONG": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "DATE": T.DateType()}


def _struct(text: str) -> T.StructType:
    """``name KIND, ...`` as a schema; unlike ``fromDDL`` it needs no running session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in text.split(","))])


HOTSPOT = _struct(
    "ord LONG, latitude DOUBLE, longitude DOUBLE, acq_date DATE, confidence STRING, frp DOUBLE"
)
FIRE_EVENT = _struct(
    "fire_id STRING, lat_mean DOUBLE, lon_mean DOUBLE, frp_sum DOUBLE, frp_mean DOUBLE, count LONG, "
    "date_first DATE, date_last DATE, duration_days INT, area_ha DOUBLE"
)
SYNTHETIC_POINT = _struct("point_id STRING, region STRING, source STRING, lat DOUBLE, lon DOUBLE, date DATE")
COVER_LEGEND = _struct("code INT, label STRING")
RINGS = T.StructType(
    [
        T.StructField("region", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("ring", T.ArrayType(_struct("x DOUBLE, y DOUBLE"))),
    ]
)
RASTER_CELL = _struct("row INT, col INT, value DOUBLE")

WEATHER_COLUMNS = (
    "temp_mean",
    "temp_max",
    "temp_min",
    "humidity_mean",
    "precipitation",
    "wind_speed_max",
    "wind_gusts_max",
    "pressure_mean",
    "cloud_cover",
    "radiation",
    "evapotranspiration",
    "sunshine_seconds",
)
WEATHER_DAILY = _struct(
    "row INT, col INT, date DATE, " + ", ".join(f"{c} DOUBLE" for c in WEATHER_COLUMNS)
)
S2_SCENE = _struct("scene_id LONG, row INT, col INT, obs_date DATE, b3 DOUBLE, b4 DOUBLE, b8 DOUBLE")
S2_CLOUD = _struct("scene_id LONG, cs_cdf DOUBLE")
