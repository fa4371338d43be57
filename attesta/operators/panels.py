"""Small rules around the reports: panels, targets, routing and classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import DATED_RANGE, LINKS, PAGE_WALLS, STAGES, WALLS
from ..functions.text import employer_keys, first_integer, keyword_routes


def link_url(kind: Column, value: Column) -> Column:
    """Address of an identity; null for kinds without one."""
    out = F.lit(None).cast("string")
    for k, template in LINKS.items():
        out = F.when(kind == k, F.format_string(template, value)).otherwise(out)
    return out


def collection_panel(refs: DataFrame, done: DataFrame, refused: DataFrame, remaining: Column) -> DataFrame:
    """For each requirement: to do, done and refused passed refs, and how many to read by default."""
    r = refs.where("state = 'passed'").select("req_id", "ref_value")
    r = r.join(done.select("ref_value", F.lit(True).alias("d")).distinct(), "ref_value", "left").join(refused.select("ref_value", F.lit(True).alias("x")).distinct(), "ref_value", "left")
    is_done, is_refused = F.coalesce("d", F.lit(False)), F.coalesce("x", F.lit(False))
    out = r.groupBy("req_id").agg(F.count_if(~is_done & ~is_refused).alias("todo"), F.count_if(is_done).alias("done"), F.count_if(~is_done & is_refused).alias("refused"))
    return out.withColumn("default_count", F.least(F.col("todo"), F.greatest(F.lit(0), remaining)))


def find_more(busy: Column, depth: Column, deepest: int) -> Column:
    """What asking for more results leads to."""
    return F.when(busy, "busy").when(depth >= deepest, "deepest").otherwise("started")


def named_only(rows: DataFrame, names: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the named keys, names that no row has: an error if not empty)."""
    return rows.join(names.select(key).distinct(), key, "left_semi"), names.select(key).distinct().join(rows, key, "left_anti")


def corroboration_targets(shortlist: DataFrame, done: DataFrame, stop: list[str], cues: list[str]) -> DataFrame:
    """Ranked subjects not yet done, with a name and an employer that identifies something, in their order."""
    ok = (F.coalesce(F.trim("name"), F.lit("")) != "") & (F.size(employer_keys("employer", stop, cues)) > 0)
    return shortlist.join(done.select("subject_id").distinct(), "subject_id", "left_anti").where(ok).orderBy("rank")


def current_employer(claims: DataFrame) -> DataFrame:
    """Each subject's newest employer that a third party didn't state; undated ones last."""
    rows = claims.where("claim_type = 'employer' AND tier <> 'third_party_stated'")
    return rows.groupBy("subject_id").agg(F.max_by("claim_value", F.struct(F.col("observed_at").isNotNull(), "observed_at", "claim_id")).alias("employer"))


def assign_contacts(contacts: DataFrame, routes: dict[str, list[str]], capacity: int) -> DataFrame:
    """Contacts by the keywords of their headline to requirements, each up to its capacity, by ref_value."""
    r = contacts.select("*", F.explode(keyword_routes("headline", routes)).alias("req_id"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("req_id").orderBy("ref_value"))).where(F.col("place") <= capacity)


def region_choices(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled codes that have places."""
    return labels.join(regions.select("code").distinct(), "code", "left_semi")


def wall_marker(page: Column) -> Column:
    """The first marker of a wall that a page holds, without regard to case; null if it holds none."""
    low = F.lower(F.coalesce(page, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(m.lower())), F.lit(m)) for m in WALLS])


def stage_name(kind: Column) -> Column:
    """What a requirement's queue is doing, for readers."""
    out = F.lit("Starting up")
    for k, name in STAGES.items():
        out = F.when(kind == k, name).otherwise(out)
    return out


def company_field(label: Column, value: Column) -> Column:
    """The field that a line of a company's overview belongs to: by the value's shape, else by its label."""
    low = F.lower(F.trim(label))
    by_value = (
        F.when(F.regexp_like(value, F.lit(r"^https?://\S+$")), "website")
        .when(F.regexp_like(value, F.lit(r"(?i)^[\d,]+(?:-[\d,]+|\+)?\s+employees$")), "size")
        .when(F.regexp_like(value, F.lit(r"^(?:18|19|20)\d{2}$")), "founded")
        .when(F.regexp_like(value, F.lit(r"(?i)^[\d,]+\s+followers$")), "followers")
    )
    return F.coalesce(by_value, F.when(low.isin("industry", "headquarters", "type", "specialties", "phone"), low))


def overview_fields(lines: DataFrame) -> DataFrame:
    """(company, fields): overview lines (company, pos, label, value) as a map, the first value of each field."""
    f = lines.withColumn("field", company_field(F.col("label"), F.col("value"))).where("field IS NOT NULL")
    one = f.groupBy("company", "field").agg(F.min_by("value", "pos").alias("value"))
    return one.groupBy("company").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def post_counts(reactions: Column, comments: Column) -> Column:
    return F.struct(F.coalesce(first_integer(reactions), F.lit(0)).alias("reactions"), F.coalesce(first_integer(comments), F.lit(0)).alias("comments"))


def page_fields(page: Column) -> tuple[Column, ...]:
    """rendered, authwalled, has_experience and dated_entries of a page's whole text."""
    text = F.coalesce(page, F.lit(""))
    low = F.lower(text)
    walled = F.lit(False)
    for marker in PAGE_WALLS:
        walled = walled | F.contains(low, F.lit(marker))
    rendered = (F.char_length(text) > 5000) & ~walled
    return rendered.alias("rendered"), walled.alias("authwalled"), F.contains(low, F.lit("experience")).alias("has_experience"), F.regexp_count(text, F.lit(DATED_RANGE)).alias("dated_entries")
