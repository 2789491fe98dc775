"""Counter-based uniforms: the same key gives the same draw on any partitioning and after any retry."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, *key: Column | str) -> Column:
    """Hash of a draw's identity. One digest holds four independent draws."""
    parts = [F.lit(str(seed))] + [F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]
    return F.md5(F.concat_ws("|", *parts))


def draw(digest_col: Column, slot: int) -> Column:
    """Uniform in [0, 1) from one of the four 32-bit slots of a digest."""
    return F.conv(F.substring(digest_col, 1 + 8 * slot, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw_between(digest_col: Column, slot: int, low, high) -> Column:
    return low + draw(digest_col, slot) * (high - low)


def draw_int(digest_col: Column, slot: int, low: int, high: int) -> Column:
    """Whole number in [low, high], both included."""
    return (F.floor(draw(digest_col, slot) * F.lit(high - low + 1)) + F.lit(low)).cast("int")
