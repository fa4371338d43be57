"""Gates, five components and one score for each (requirement, subject), set-based.

Claims are filtered to what a requirement can use and aggregated once by (requirement, subject); the wanted terms of
requirements are a small dimension that is joined on the claim key, not a per-subject loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.constants import BANNED, COMPONENTS, DEPTH_CAP, NICE_WEIGHT, NONE_HELD_FACTOR, PROFILES, SCORER_VERSION, TIERS, WEIGHTS
from ..functions.text import banned_signal
from ..functions.timefn import days_between, decay
from . import scan
from .dictionary import compatible
from .gate import names_foreign
from .relational import latest_per_key, upsert


def wanted_terms(requirements: DataFrame) -> DataFrame:
    """(req_id, claim_key, weight, must): must-haves at 1, others at less; a must-have isn't wanted twice."""
    must = requirements.select("req_id", F.explode(F.array_distinct("must_have")).alias("claim_key"), F.lit(1.0).alias("weight"), F.lit(True).alias("must"))
    nice = requirements.select("req_id", F.explode(F.array_except("nice_to_have", "must_have")).alias("claim_key"), F.lit(NICE_WEIGHT).alias("weight"), F.lit(False).alias("must"))
    return must.unionByName(nice)


def components(requirements: DataFrame, claims: DataFrame, as_of: Column, pairs: DataFrame, depth_cap: float = DEPTH_CAP) -> DataFrame:
    """Facts and components of each pair (req_id, subject_id): the subjects that a search attached to a requirement.

    A foreign place is that of the first claim (by claim_id, where claims have one; else by its text). Three aggregates over the claims (by subject and wanted term,
    by subject with values of fixed size only, location rows), then joins by subject.
    """
    usable = claims.where(banned_signal("claim_type", "claim_key", BANNED).isNull())
    artifact = F.col("tier") == "artifact_backed"
    terms = wanted_terms(requirements)
    held = (
        usable.where((F.col("claim_type") == "skill") & (F.coalesce("claim_key", F.lit("")) != ""))
        .join(terms, "claim_key")
        .groupBy("req_id", "subject_id", "claim_key", "weight", "must")
        .agg(
            F.max(F.when(F.col("tier").isin(TIERS), 1.0).otherwise(0.0)).alias("best"),
            F.sum(F.when(artifact, F.coalesce("value_num", F.lit(0.0)))).alias("volume"),
            F.max(F.when(artifact, F.col("observed_at"))).alias("newest"),
            F.count_if(artifact).alias("artifacts"),
        )
    )
    recency = F.when(F.col("newest").isNull(), 0.5).otherwise(decay(days_between(as_of, F.col("newest"))))
    skill = held.groupBy("req_id", "subject_id").agg(
        F.sum(F.col("weight") * F.col("best")).alias("earned"),
        F.sum(F.when(F.col("must") & (F.col("artifacts") > 0), scores.depth(F.col("volume"), depth_cap) * recency).otherwise(0.0)).alias("depth_sum"),
        F.array_sort(F.collect_set(F.when(F.col("must"), F.col("claim_key")))).alias("must_held"),
    )
    facts = usable.groupBy("subject_id").agg(
        F.max(F.when(artifact, F.col("observed_at"))).alias("latest"),
        F.min(F.when(artifact, F.col("observed_at"))).alias("earliest"),
        F.max(F.when(F.col("claim_type") == "experience_years", F.col("value_num"))).alias("stated_years"),
        F.max(F.when(F.col("claim_type") == "availability", 1.0).otherwise(0.0)).alias("available"),
    )
    places = usable.where("claim_type = 'location'").groupBy("subject_id").agg(
        F.array_sort(F.collect_set(F.nullif(F.col("claim_key"), F.lit("")))).alias("regions_held"),
        F.min_by(F.trim("claim_value"), F.when(names_foreign(F.col("claim_value")), F.struct(*([F.col("claim_id")] if "claim_id" in claims.columns else []), F.trim("claim_value").alias("v")))).alias("foreign_place"),
    )
    base = pairs.select("req_id", "subject_id").distinct().join(facts, "subject_id", "left").join(places, "subject_id", "left").join(skill, ["req_id", "subject_id"], "left").join(requirements, "req_id")
    total = F.aggregate("must_have", F.lit(0.0), lambda a, _: a + 1.0) + NICE_WEIGHT * F.size(F.array_except("nice_to_have", "must_have"))
    years = F.coalesce("stated_years", days_between(as_of, F.col("earliest")) / F.lit(365.25))
    basis = F.when(F.col("stated_years").isNotNull(), "computed").when(F.col("earliest").isNotNull(), "estimated").otherwise("unknown")
    none = F.array().cast("array<string>")
    made = base.select(
        *requirements.columns, "subject_id", "latest", "foreign_place", basis.alias("seniority_basis"),
        F.coalesce("regions_held", none).alias("regions_held"), F.coalesce("must_held", none).alias("must_held"),
        scores.clamp(F.when(total > 0, F.coalesce("earned", F.lit(0.0)) / total).otherwise(0.0)).alias("skill_match"),
        scores.clamp(F.when(F.size("must_have") > 0, F.coalesce("depth_sum", F.lit(0.0)) / F.size("must_have")).otherwise(0.0)).alias("skill_depth"),
        scores.clamp(scores.seniority(years, F.col("min_years").cast("double"))).alias("seniority_fit"),
        scores.clamp(F.when(F.col("latest").isNull(), 0.0).otherwise(decay(days_between(as_of, F.col("latest"))))).alias("activity_recency"),
        scores.clamp(F.coalesce("available", F.lit(0.0))).alias("availability"),
    )
    return allowed_only(made, [*requirements.columns, "subject_id", "latest", "foreign_place", "seniority_basis", "regions_held", "must_held"])


def allowed_only(scored: DataFrame, facts: list[str]) -> DataFrame:
    """``scored``, if what it holds besides ``facts`` are exactly the components that may be scored; else an error."""
    found = set(scored.columns) - set(facts)
    if found != set(COMPONENTS):
        raise ValueError(f"components {sorted(found)} differ from the allowed {sorted(COMPONENTS)}")
    return scored


def gates(as_of: Column) -> dict[str, Column]:
    """Verdict texts over the columns that ``components`` gives."""
    must, held = F.col("must_have"), F.col("must_held")
    missing = F.array_except(must, held)
    musts = F.when(F.size(missing) == 0, "pass").otherwise(
        F.concat(F.lit("pass: has "), (F.size(must) - F.size(missing)).cast("string"), F.lit(" of "), F.size(must).cast("string"), F.lit("; no evidence for "), F.array_join(missing, ", "))
    )
    wanted, own = F.array_join("regions", ", "), F.col("regions_held")
    location = (
        F.when(F.col("remote").isin("remote", "remote_relocate"), "pass: role is remote")
        .when(F.size("regions") == 0, "pass: role has no location requirement")
        .when(F.exists(own, lambda r: compatible(r, F.col("regions"))), "pass")
        .when(F.size(own) > 0, F.concat(F.lit("pass: "), F.array_join(own, ", "), F.lit(" is outside "), wanted, F.lit(" — would need to relocate")))
        .when(F.col("foreign_place").isNotNull(), F.concat(F.lit("fail: "), F.col("foreign_place"), F.lit(" is outside "), wanted))
        .otherwise("pass: location unknown")
    )
    days = days_between(as_of, F.col("latest"))
    activity = (
        F.when(F.col("latest").isNull(), "skip: no artefact evidence")
        .when(days <= F.col("max_staleness_days"), "pass")
        .otherwise(F.concat(F.lit("fail: most recent public work "), F.floor(days).cast("string"), F.lit(" days old, limit "), F.col("max_staleness_days").cast("string")))
    )
    return {"gate_must_have": musts, "gate_location": location, "gate_activity": activity}


def evaluate(requirements: DataFrame, claims: DataFrame, as_of: Column, pairs: DataFrame, weights: DataFrame | None = None, depth_cap: float = DEPTH_CAP) -> DataFrame:
    """One row for each pair (req_id, subject_id): gates, components, score, passed, label.

    ``weights`` has (profile, version, w_<component>) with one active row a profile; without it all weigh 0.2.
    """
    rows = components(requirements, claims, as_of, pairs, depth_cap)
    if weights is None:
        w = {c: F.lit(WEIGHTS[c]) for c in COMPONENTS}
        rows = rows.withColumn("version", F.lit("v1"))
    else:
        rows = rows.join(weights.select("profile", "version", *[f"w_{c}" for c in COMPONENTS]), "profile")
        w = {c: F.col(f"w_{c}") for c in COMPONENTS}
    score = sum((w[c] * F.col(c) for c in COMPONENTS), F.lit(0.0))
    score = scores.rounded(F.when((F.size("must_have") > 0) & (F.size("must_held") == 0), score * NONE_HELD_FACTOR).otherwise(score))
    g = gates(as_of)
    out = rows.select("req_id", "subject_id", *COMPONENTS, "seniority_basis", F.col("version").alias("weights_version"), score.alias("score"), *[c.alias(n) for n, c in g.items()])
    failed = [F.startswith(F.col(n), F.lit("fail")) for n in g]
    return out.withColumn("passed", ~(failed[0] | failed[1] | failed[2])).withColumn("label", scores.label(F.col("score"))).withColumn("scorer_version", F.lit(SCORER_VERSION))


def active_weights(weights: DataFrame) -> DataFrame:
    """The newest active row of each profile."""
    return latest_per_key(weights.where("active"), ["profile"], [F.desc("weights_id")])


def profile_of(expects: Column) -> Column:
    """The weight profile of a requirement, by whether artifacts can be expected of its people."""
    return F.when(expects, PROFILES[True]).otherwise(PROFILES[False])


def upsert_matches(existing: DataFrame, scored: DataFrame) -> DataFrame:
    """One match for each requirement, subject and pair of versions; a new score replaces an older one of its key."""
    key = ["req_id", "subject_id", "scorer_version", "weights_version"]
    return upsert(existing, scored, key, ["scored_at"], [c for c in existing.columns if c not in (*key, "match_id")])


def current_matches(matches: DataFrame) -> DataFrame:
    """The latest score of each (requirement, subject), over versions."""
    return latest_per_key(matches, ["req_id", "subject_id"], [F.col("scored_at").desc_nulls_last(), F.desc("match_id")])


def ranked(scored: DataFrame, by: str, tie: str = "subject_id") -> DataFrame:
    """Rows with their rank in ``by``: by score, then ``tie``. Scores are computed once; see ``scan.ranked``."""
    return scan.ranked(scored, [by], F.col("score"), tie)
