"""Date expressions."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Besides ISO texts: the month comes first where both orders make a date.
DATE_FORMATS = ("yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "yyyyMMdd")
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Day named by an ISO text, with or without a time, or by a text in any of ``formats``; NULL where none fits."""
    text = F.trim(c)
    iso = F.when(text.rlike(ISO_TIME), F.substring(text, 1, 10).try_cast("date"))
    return F.coalesce(iso, F.to_date(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])))


def day_prefix(c: Column) -> Column:
    """Day named by the first ten characters of a date text."""
    return F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))


def clamped_date(year: Column, month: Column, day: Column) -> Column:
    """A date whose day never exceeds 28, so that it exists in every month."""
    return F.make_date(year, month, F.least(day, F.lit(28)))
