"""The three roundings the workload mixes. Plain ``F.round`` (half up) matches none of them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def np_round(c: Column, decimals: int = 2) -> Column:
    """Scale, round half to even, scale back: what numpy does with an array."""
    scale = float(10**decimals)
    return F.rint(c * scale) / scale


def py_round(c: Column, decimals: int = 2) -> Column:
    """Half-even on the decimal value, as Python's ``round(x, n)``."""
    return F.bround(c, decimals)


def to_count(c: Column) -> Column:
    """Half-even to a whole number, as Python's ``round(x)``."""
    return F.rint(c).cast("long")


def grid_units(c: Column, decimals: int = 2) -> Column:
    """A rounded coordinate as a whole number of ``10**-decimals`` degrees.

    Sums of these are exact, so means of rounded coordinates do not depend on task order.
    """
    return F.rint(c * float(10**decimals)).cast("long")
