"""Claims: refusals in a fixed order, upsert, quarantine, and the rows that sources give rise to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BANNED, TIERS
from ..functions.text import banned_signal, quotable
from .dictionary import canonical, region_of
from .relational import top_k, upsert

KEY = ["subject_id", "claim_type", "claim_key", "source_url"]
UPDATED = ["observed_at", "claim_value", "value_num", "snippet", "extractor_version"]


def refusal(source_text: Column | None = None, refused_types: list[str] = ()) -> Column:
    """Struct of bucket and reason of the first refusal; null where a row is accepted."""
    source = F.lit(None).cast("string") if source_text is None else source_text
    kind, banned = F.col("claim_type"), banned_signal("claim_key", "claim_value", BANNED)
    no = lambda bucket, *text: F.struct(F.lit(bucket).alias("bucket"), F.concat(kind, *text).alias("reason"))
    out = F.when(F.coalesce(F.trim("snippet"), F.lit("")) == "", no("invalid", F.lit(": empty snippet")))
    out = out.when(~F.coalesce(F.col("tier").isin(TIERS), F.lit(False)), no("invalid", F.lit(": unknown tier '"), F.coalesce("tier", F.lit("")), F.lit("'")))
    if refused_types:
        out = out.when(kind.isin(list(refused_types)), no("banned", F.lit(": refused claim type")))
    out = out.when(banned.isNotNull(), no("banned", F.lit(": names banned signal '"), banned, F.lit("'")))
    return out.when(~quotable(F.col("snippet"), source), no("unquotable", F.lit(": snippet not found in source")))


def validate(rows: DataFrame, source_text: str | None = None, refused_types: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with bucket and reason)."""
    judged = rows.withColumn("_r", refusal(F.col(source_text) if source_text else None, refused_types))
    return judged.where("_r IS NULL").drop("_r"), judged.where("_r IS NOT NULL").select(*rows.columns, "_r.bucket", "_r.reason")


def write_claims(existing: DataFrame, accepted: DataFrame, as_of: Column) -> DataFrame:
    """One row for each null-safe key: five columns follow the newest row, tier and extractor stay with the first."""
    seen = accepted.withColumn("observed_at", F.coalesce("observed_at", as_of))
    return upsert(existing, seen.select(existing.columns), KEY, ["observed_at", "claim_value", "snippet"], UPDATED)


def quarantine(failures: DataFrame) -> DataFrame:
    """One failure for each fetch and extractor version, the earliest; those without a fetch all stay."""
    known = failures.where("fetch_id IS NOT NULL").groupBy("fetch_id", "extractor_version").agg(F.min_by(F.struct(*[c for c in failures.columns if c not in ("fetch_id", "extractor_version")]), F.struct("failed_at", "error")).alias("_f"))
    return known.select("fetch_id", "extractor_version", "_f.*").select(failures.columns).unionByName(failures.where("fetch_id IS NULL"))


def without_banned(claims: DataFrame) -> DataFrame:
    """Read-time filter of the same signals."""
    return claims.where(banned_signal("claim_key", F.lit(None).cast("string"), BANNED).isNull())


def usable_repo() -> Column:
    """Struct of usable and reason of a repository: private, archived without stars, or a fork that isn't the person's own work."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    reason = (
        F.when(yes("private"), "private")
        .when(yes("archived") & none("stars"), "archived with no stars")
        .when(yes("fork") & none("size"), "fork with no content")
        .when(yes("fork") & (low("owner") != low("login")), "fork owned by someone else")
        .when(yes("fork") & F.col("pushed_at").isNull(), "fork with no commits by this user")
    )
    return F.struct(reason.isNull().alias("usable"), F.coalesce(reason, F.lit("")).alias("reason"))


def language_shares(repos: DataFrame, skip: list[str], least: float = 0.10) -> DataFrame:
    """Repos (with a map ``languages`` of bytes) by language: those with at least a share of the repo's bytes, but for ``skip``."""
    total = F.aggregate(F.map_values("languages"), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = repos.withColumn("_total", total).select("*", F.explode("languages").alias("language", "bytes"))
    return rows.withColumn("share", F.col("bytes") / F.col("_total")).where((F.col("share") >= least) & ~F.lower("language").isin([x.lower() for x in skip])).drop("_total", "languages")


def language_claims(repos: DataFrame, terms: DataFrame, skip: list[str], least: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """(skill claims of repos' languages under their canonical names, proposals: languages that no alias knows)."""
    known, unknown = canonical(language_shares(repos, skip, least), "language", terms)
    name, day = F.col("canonical"), F.date_format("pushed_at", "yyyy-MM-dd")
    snippet = F.concat(
        name, F.lit(": "), F.format_number("bytes", 0), F.lit(" bytes ("), F.bround(F.col("share") * 100).cast("int").cast("string"), F.lit("% of "), F.coalesce("repo", F.lit("repository")), F.lit(")"),
        F.coalesce(F.concat(F.lit(", last pushed "), day), F.lit("")),
    )
    url = F.coalesce("url", F.concat(F.lit("https://github.com/"), F.col("login")))
    return known.where(name.isNotNull()).select(
        "subject_id", F.lit("skill").alias("claim_type"), name.alias("claim_key"), name.alias("claim_value"), F.col("bytes").cast("double").alias("value_num"), F.lit("artifact_backed").alias("tier"),
        url.alias("source_url"), snippet.alias("snippet"), F.col("pushed_at").alias("observed_at"), F.lit("github").alias("extractor"),
    ), unknown


def account_claims(accounts: DataFrame, regions: DataFrame) -> DataFrame:
    """Location and availability that people (not organisations) state on a code host's page."""
    people = accounts.where("account_type = 'User'").select("subject_id", F.nullif(F.trim("location"), F.lit("")).alias("place"), "hireable", "url")
    people = people.join(region_of(people.where("place IS NOT NULL"), "subject_id", "place", regions), "subject_id", "left")
    claim = lambda kind, key, value, snippet, when: F.when(when, F.struct(F.lit(kind).alias("claim_type"), key.alias("claim_key"), value.alias("claim_value"), snippet.alias("snippet")))
    none = F.lit(None).cast("string")
    rows = F.array_compact(F.array(
        claim("location", F.col("region"), F.col("place"), F.concat(F.lit("Location on GitHub profile: "), "place"), F.col("place").isNotNull()),
        claim("availability", none, F.lit("hireable"), F.lit("GitHub profile is marked as available for hire"), F.col("hireable").eqNullSafe(True)),
    ))
    return people.select("subject_id", F.lit("self_reported").alias("tier"), F.coalesce("url", F.lit("")).alias("source_url"), F.lit("github").alias("extractor"), F.inline(rows))


def capped_repos(repos: DataFrame, cap: int = 30) -> DataFrame:
    """Of each person's ``cap`` most recently pushed repos the usable ones; organisations give none."""
    return top_k(repos.where("account_type = 'User'"), ["subject_id"], [F.col("pushed_at").desc_nulls_last(), F.asc("repo")], cap).drop("rank").where(usable_repo()["usable"])


def person_claims(p: DataFrame, as_of: Column) -> DataFrame:
    """Claims of a profile (subject_id, title, employer, years, skills, education, location, region, open_to_work, url).

    One pass: an array of claim structs is exploded instead of a union of eight scans.
    """
    none = F.lit(None).cast("string")
    one = lambda kind, key, value, num, when: F.when(when, F.struct(F.lit(kind).alias("claim_type"), key.alias("claim_key"), value.alias("claim_value"), num.cast("double").alias("value_num")))
    num = F.lit(None)
    c = F.col
    rows = F.array_compact(F.array(
        one("title", none, c("title"), num, c("title").isNotNull()),
        one("employer", none, c("employer"), num, c("employer").isNotNull()),
        one("experience_years", none, none, c("years"), c("years").isNotNull()),
        one("education", none, c("education"), num, c("education").isNotNull()),
        one("location", c("region"), c("location"), num, c("location").isNotNull()),
        one("availability", none, F.lit("open"), num, c("open_to_work").eqNullSafe(True)),
        one("link", none, c("url"), num, c("url").isNotNull()),
    ))
    skills = F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.struct(F.lit("skill").alias("claim_type"), s.alias("claim_key"), s.alias("claim_value"), F.lit(None).cast("double").alias("value_num")))
    return p.select("subject_id", F.lit("self_reported").alias("tier"), F.col("url").alias("source_url"), as_of.alias("observed_at"), F.inline(F.concat(rows, skills)))


def listed_skills(people: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skill claims of listed lines and of the terms that these imply, proposals: lines that no alias knows).

    ``people`` has subject_id, url and skills. An inferred claim says from what, and stays as weak as its source.
    """
    rows, unknown = canonical(people.select("subject_id", "url", F.explode("skills").alias("line")), "line", terms)
    implied = terms.groupBy(F.col("name").alias("canonical")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("implies")))).alias("implies"))
    rows = rows.where("canonical IS NOT NULL").join(implied, "canonical")
    listed = F.concat("line", F.lit(" — listed in the Skills section of the LinkedIn profile"))
    own = F.struct(F.col("canonical").alias("claim_key"), listed.alias("snippet"))
    more = F.transform("implies", lambda x: F.struct(x.alias("claim_key"), F.concat(listed, F.lit(" ("), F.col("canonical"), F.lit(" is written in "), x, F.lit(")")).alias("snippet")))
    out = rows.select("subject_id", F.col("url").alias("source_url"), F.inline(F.concat(F.array(own), more)))
    return out.select("subject_id", F.lit("skill").alias("claim_type"), "claim_key", F.col("claim_key").alias("claim_value"), F.lit("self_reported").alias("tier"), "source_url", "snippet"), unknown


def page_claims(windows: DataFrame, employer: str, title: str) -> DataFrame:
    """Employer and title claims of windows (subject_id, url, window) in which a third party names a person by both."""
    claim = lambda kind, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("claim_type"), F.lower(c).alias("claim_key"), F.col(c).alias("claim_value")))
    rows = F.array_compact(F.array(claim("employer", employer), claim("title", title)))
    return windows.select("subject_id", F.lit("third_party_stated").alias("tier"), F.col("url").alias("source_url"), F.col("window").alias("snippet"), F.inline(rows))


def stale_claims(stored: DataFrame, parsed: DataFrame, doc: str) -> DataFrame:
    """Stored values that a new parse of their document no longer holds; documents without a parse are left alone."""
    checked = parsed.select(doc).distinct()
    return stored.join(checked, doc, "left_semi").join(parsed.select(doc, "claim_value").distinct(), [doc, "claim_value"], "left_anti")


def evidence_bodies(claims: DataFrame, fetches: DataFrame, adapter: str) -> DataFrame:
    """(subject_id, body_path): the distinct stored bodies of an adapter that a subject's claims were read from."""
    known = fetches.where((F.col("adapter") == adapter) & F.col("body_path").isNotNull()).select("fetch_id", "body_path")
    return claims.where("fetch_id IS NOT NULL").select("subject_id", "fetch_id").distinct().join(known, "fetch_id").select("subject_id", "body_path").distinct()
