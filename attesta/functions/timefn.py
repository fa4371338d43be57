"""Dates and decay. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import HALF_LIFE_DAYS, MONTHS
from .text import col


def parse_month(c: Column | str) -> Column:
    """ "Jan 2020", "January 2020" or "2020" (1 January) to a date; present, junk and null to null."""
    t = F.replace(F.lower(F.trim(col(c))), F.lit("."), F.lit(""))
    word, year = (F.regexp_extract(t, r"([a-z]{3,9})\s+(\d{4})", i) for i in (1, 2))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(word, 1, 3)).cast("int")
    bare = F.regexp_extract(t, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    return F.when(t.isin("", "present", "current", "now"), None).when((word != "") & (month > 0), F.make_date(year.try_cast("int"), month, F.lit(1))).when(bare.isNotNull(), F.make_date(bare, F.lit(1), F.lit(1)))


def spans(df: DataFrame, start: str, end: str, as_of: Column) -> DataFrame:
    """Rows with a start not after ``as_of``; open ends close there, ends are clamped to [start, as_of]."""
    return df.where(F.col(start).isNotNull() & (F.col(start) <= as_of)).withColumn(end, F.least(F.greatest(F.coalesce(F.col(end), as_of), F.col(start)), as_of))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, 0 if negative; null where a date is."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    days = (micros(later) - micros(earlier)).cast("double") / 86_400e6
    return F.when(days.isNotNull(), F.greatest(F.lit(0.0), days))


def decay(days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(0.5), days / float(half_life))


def epoch_age(as_of: Column, c: Column | str) -> Column:
    """Whole seconds since."""
    return F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(col(c).cast("timestamp"))) / 1_000_000).cast("long")


def iso_timestamp(c: Column | str) -> Column:
    """ISO time with or without Z; invalid ones are null."""
    return F.try_to_timestamp(col(c))


def whole_years(days: Column) -> Column:
    """Whole years; null under one."""
    y = F.floor(days / F.lit(365.25))
    return F.when(y >= 1, y)


def observed(end: Column, start: Column, as_of: Column) -> Column:
    return F.coalesce(end, F.when(start.isNotNull(), as_of))
