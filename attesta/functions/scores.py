"""Score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DECIMALS, DEPTH_CAP, LABELS, SENIORITY_SLACK_YEARS


def rounded(c: Column, decimals: int = DECIMALS) -> Column:
    """A double rounded as SQL engines do: the scaled value to a whole one.

    Spark's own rounding goes by the shortest decimal of the double, so the two part where a half is no double.
    """
    scale = float(10**decimals)
    return F.round(c * scale) / scale


def clamp(c: Column) -> Column:
    return rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def depth(volume: Column, cap: float = DEPTH_CAP) -> Column:
    return F.when(volume > 0, F.least(F.lit(1.0), F.log1p(volume) / F.log1p(F.lit(float(cap))))).otherwise(0.0)


def seniority(years: Column, least: Column) -> Column:
    """1 from the minimum on, falling to 0 over the slack below it; unknown years are 0."""
    return F.when(years.isNull(), 0.0).when(least.isNull() | (years >= least), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (least - years) / SENIORITY_SLACK_YEARS))


def label(score: Column) -> Column:
    out = F.when(score.isNull(), "Not yet ranked")
    for least, name in LABELS:
        out = out.when(score >= least, name)
    return out.otherwise("Weak")


def segments(score: Column, total: int = 5) -> Column:
    """Filled segments of a bar; ties round to even."""
    return F.when(F.coalesce(score, F.lit(0.0)) == 0.0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(total), F.bround(score * total).cast("int"))))
