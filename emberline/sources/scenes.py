"""Satellite scenes stored so that a look-up opens only the months and places it asks for.

One folder per (span, tile): a span is a stretch of days, a tile a square of pixels. Each scene carries its cloud score, so
scenes meet scores once, when they are stored.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.geo import RasterMeta
from emberline.operators.skew import shuffled

PARTITION = ["span", "tile"]
#: Tiles of a grid at most: (span, tile) pairs, which go to all tasks, are bounded by the calendar and this.
MAX_TILES = 1024
SCHEMA = "scene_id long, row int, col int, obs_date date, b3 double, b4 double, b8 double, cs_cdf double, span int, tile int"


@dataclass(frozen=True)
class SceneStore:
    """Where scenes lie and how they are cut: ``span_days`` a span, ``side`` pixels a tile's edge, ``across`` tiles a row, ``down`` a column.

    Pixels beyond the grid share its tiles, as if it were repeated in all directions: the folders stay as few.
    """

    path: str
    span_days: int
    side: int
    across: int
    down: int

    @classmethod
    def of(cls, path: str, meta: RasterMeta, span_days: int = 30) -> "SceneStore":
        side = 1
        while -(-meta.rows // side) * -(-meta.cols // side) > MAX_TILES:
            side *= 2
        return cls(path, span_days, side, -(-meta.cols // side), -(-meta.rows // side))

    def span(self, day: Column) -> Column:
        return F.floor(F.unix_date(day) / self.span_days).cast("int")

    def tile(self, row: Column, col: Column) -> Column:
        place = lambda p, n: F.pmod(F.floor(p / self.side), F.lit(n))
        return (place(row, self.down) * self.across + place(col, self.across)).cast("int")

    def write(self, scenes: DataFrame, clouds: DataFrame) -> None:
        """Store the scenes that have a cloud score, replacing what was there. A crowded folder gets several files."""
        scored = shuffled(scenes).join(clouds.select("scene_id", "cs_cdf"), "scene_id")
        placed = scored.withColumns({"span": self.span(F.col("obs_date")), "tile": self.tile(F.col("row"), F.col("col"))})
        placed.hint("rebalance", *PARTITION).write.mode("overwrite").partitionBy(*PARTITION).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(self.path)

    def near(self, wanted: DataFrame, clear_sky: float) -> DataFrame:
        """Clear scenes of the spans and tiles of ``wanted`` (``row, col, span``); folders of others are not opened.

        The distinct (span, tile) pairs prune the scan while it runs. There are as many as spans since the first satellite,
        times MAX_TILES, at most, so their broadcast does not grow with points or scenes.
        """
        asked = wanted.select("span", self.tile(F.col("row"), F.col("col")).alias("tile")).where("tile >= 0").distinct()
        clear = self.read(wanted.sparkSession).where(F.col("cs_cdf") >= clear_sky)
        return clear.join(F.broadcast(asked), PARTITION, "left_semi")
