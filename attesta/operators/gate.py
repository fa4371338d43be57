"""Ordered gates: the first rule that fails decides and says why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FOREIGN, RESCUE_BELOW
from ..functions.text import acceptable_titles, first_excluded, mentions_country, normalise_country, title_matches
from .dictionary import compatible
from .relational import null_safe_lookup


def ordered_gate(rules: list[tuple[Column, Column]], note: Column | None = None) -> Column:
    """Struct of passed and reason from (fails, reason) rules; a pass may carry a note."""
    reason = None
    for fails, text in rules:
        fails = F.coalesce(fails, F.lit(False))
        reason = F.when(fails, text) if reason is None else reason.when(fails, text)
    passed = reason.isNull()
    return F.struct(passed.alias("passed"), F.when(passed, note if note is not None else F.lit(None).cast("string")).otherwise(reason).alias("reason"))


def foreign_place(location: Column) -> Column:
    """The first comma part of a location that names a country which disproves it; null if none does."""
    return F.get(F.filter(F.transform(F.split(location, ","), lambda p: F.trim(p)), lambda p: normalise_country(p).isin(FOREIGN)), F.lit(0))


def names_foreign(location: Column) -> Column:
    return foreign_place(location).isNotNull()


def snippet_gate(title: Column, headline: Column, employer: Column, raw: Column, location: Column, region: Column, spec: dict[str, Column]) -> Column:
    """Title, employer and location of a snippet against a requirement.

    ``spec`` has columns titles, must_have, excluded, regions (arrays) and remote. ``region`` is the resolved code of the
    location, if any. Blank locations pass, another city of the country passes with a note, foreign and unknown places fail.
    """
    blank = F.lit("")
    title, headline = F.nullif(title, blank), F.nullif(headline, blank)
    wanted = acceptable_titles(spec["titles"], spec["must_have"])
    seen = F.array_compact(F.array(title, headline))
    asks = F.size(wanted) > 0
    named = F.array_join(spec["regions"], ", ")
    place = F.trim(location)
    by_place = (F.size(spec["regions"]) > 0) & (F.coalesce(spec["remote"], blank) != "remote") & (F.coalesce(place, blank) != "")
    hit = first_excluded([F.coalesce(employer, blank), F.coalesce(headline, blank), F.coalesce(raw, blank)], spec["excluded"])
    rules = [
        (asks & (F.size(seen) == 0), F.lit("title: no title or headline in snippet to test")),
        (asks & ~F.exists(seen, lambda t: title_matches(t, wanted)), F.concat(F.lit("title: '"), F.array_join(seen, " / "), F.lit("' does not match "), F.array_join(wanted, " | "))),
        (hit.isNotNull(), F.concat(F.lit("employer: excluded ("), hit, F.lit(")"))),
        (by_place & names_foreign(place), F.concat(F.lit("location: "), place, F.lit(" is outside India"))),
        (by_place & region.isNull() & ~mentions_country(place), F.concat(F.lit("location: "), place, F.lit(" is not a recognised Indian location"))),
    ]
    note = F.when(by_place & region.isNotNull() & ~compatible(region, spec["regions"]), F.concat(F.lit("location: "), place, F.lit(" ("), region, F.lit(") is outside "), named))
    return ordered_gate(rules, note)


def rescue(refs: DataFrame, req: str, strict: str, loose: str, least: float = RESCUE_BELOW) -> DataFrame:
    """Where under half of a requirement's refs pass the strict verdict, its failures take the loose one, annotated.

    Counts are aggregated once a requirement and joined back, so that no task holds all refs of one.
    """
    ok = F.col(strict)["passed"]
    counts = refs.groupBy(req).agg(F.count("*").alias("_n"), F.count_if(ok).alias("_kept"))
    joined = null_safe_lookup(refs, counts, req)
    share = F.col("_kept") / F.col("_n")
    again = (share < least) & ~ok & F.col(loose)["passed"]
    note = F.concat(
        F.lit("admitted: the job-title filter refused "), (F.col("_n") - F.col("_kept")).cast("string"), F.lit(" of "), F.col("_n").cast("string"),
        F.lit(" people this search found, so it is not being trusted for this role — check the headline"),
    )
    why = F.nullif(F.col(loose)["reason"], F.lit(""))
    verdict = F.when(again, F.struct(F.lit(True).alias("passed"), F.concat(note, F.coalesce(F.concat(F.lit(" ("), why, F.lit(")")), F.lit(""))).alias("reason"))).otherwise(F.col(strict))
    return joined.withColumn("pass_share", share).withColumn("rescued", again).withColumn("verdict", verdict).drop("_n", "_kept")


def regate(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, old_state, new_state, reason) of refs whose state changes; manual ones stay as they are."""
    o = old.where(F.col("state") != "manual").select(key, F.col("state").alias("old_state"))
    n = new.select(key, F.when(F.col("verdict.passed"), "passed").otherwise("failed").alias("new_state"), F.col("verdict.reason").alias("reason"))
    return o.join(n, key).where("old_state <> new_state")


def reason_histogram(df: DataFrame, reason: str) -> DataFrame:
    """Failures by what stands before the colon."""
    return df.where(F.col(reason).isNotNull()).groupBy(F.split_part(F.col(reason), F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))
