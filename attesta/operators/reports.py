"""Shortlist, detail, overview, progress, buckets and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ACTIONS
from ..functions.scores import label, segments
from .panels import link_url, stage_name
from .relational import scalar_lookup, top_k
from .scoring import current_matches


def shortlist(matches: DataFrame, subjects: DataFrame, actions: DataFrame, claims: DataFrame, checked: DataFrame) -> DataFrame:
    """Current matches of active subjects with last action, three strongest skills (proven, else stated) and bucket."""
    now = current_matches(matches)
    # a decision on any older score of the pair counts
    last = actions.join(matches.select("match_id", "req_id", "subject_id"), "match_id").groupBy("req_id", "subject_id").agg(F.max_by("action", F.struct("acted_at", "action_id")).alias("last_action"))
    skills = claims.where("claim_type = 'skill'")
    proven = top_k(skills.where("tier = 'artifact_backed'").groupBy("subject_id", "claim_key").agg(F.sum(F.coalesce("value_num", F.lit(0.0))).alias("volume")), ["subject_id"], [F.desc("volume"), F.asc("claim_key")], 3)
    stated = top_k(skills.where("tier <> 'artifact_backed'").select("subject_id", "claim_key").distinct(), ["subject_id"], [F.asc("claim_key")], 3)
    names = lambda df, n: df.groupBy("subject_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "claim_key"))), lambda s: s["claim_key"]).alias(n))
    out = (
        now.join(subjects.where("status = 'active'").select("subject_id", "name"), "subject_id")
        .join(last, ["req_id", "subject_id"], "left")
        .join(names(proven, "proven"), "subject_id", "left")
        .join(names(stated, "stated"), "subject_id", "left")
        .join(checked.select("subject_id").distinct().withColumn("checked", F.lit(True)), "subject_id", "left")
    )
    seen = F.coalesce("checked", F.lit(False))
    bucket = F.when(~seen, "unchecked").when(F.col("passed"), "ranked").otherwise("ruled_out")
    return out.select(
        "req_id", "subject_id", "name", "score", "passed", "last_action", F.coalesce("proven", "stated").alias("top_skills"),
        label(F.col("score")).alias("label"), segments(F.col("score")).alias("segments"), bucket.alias("bucket"),
    )


def not_opened(refs: DataFrame, checked: DataFrame) -> DataFrame:
    """Failed refs whose subject was never read."""
    return refs.where("state = 'failed'").join(checked.select("subject_id").distinct(), "subject_id", "left_anti")


def weighted_components(components: Column, weights: Column) -> Column:
    """Components (a map) without those to which the weights (a map) give none; all of them where there are no weights."""
    return F.when(weights.isNull(), components).otherwise(F.map_filter(components, lambda k, _: F.coalesce(F.element_at(weights, k), F.lit(1.0)) > 0))


def detail(matches: DataFrame, claims: DataFrame, actions: DataFrame, requirements: DataFrame, identities: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """For each current match: proven and stated claims, and the five newest decisions on other requirements.

    ``identities`` add the person's links; ``weights`` (version, weights map) cut a ``components`` map to those that count.
    """
    rows = claims.groupBy("subject_id").agg(
        *[F.array_sort(F.collect_list(F.when(c, F.struct("claim_type", "claim_key", "claim_value", "source_url")))).alias(n) for n, c in (("proven", F.col("tier") == "artifact_backed"), ("says_so", F.col("tier") != "artifact_backed"))]
    )
    past = actions.join(matches.select("match_id", F.col("req_id").alias("other_req"), "subject_id"), "match_id").join(requirements.select(F.col("req_id").alias("other_req"), "titles"), "other_req")
    now = current_matches(matches)
    prior = now.select("req_id", "subject_id").join(past, "subject_id").where("other_req <> req_id")
    prior = top_k(prior, ["req_id", "subject_id"], [F.desc("acted_at"), F.desc("action_id")], 5).groupBy("req_id", "subject_id").agg(F.array_sort(F.collect_list(F.struct("rank", "other_req", "action"))).alias("prior"))
    out = now.join(rows, "subject_id", "left").join(prior, ["req_id", "subject_id"], "left")
    if identities is not None:
        links = identities.withColumn("url", link_url(F.col("kind"), F.col("value"))).groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value", "url"))).alias("links"))
        out = out.join(links, "subject_id", "left")
    if weights is not None:
        out = out.join(weights.select(F.col("version").alias("weights_version"), F.col("weights").alias("_w")), "weights_version", "left").withColumn("components", weighted_components(F.col("components"), F.col("_w"))).drop("_w")
    return out


def overview(requirements: DataFrame, refs: DataFrame, matches: DataFrame, actions: DataFrame, runs: DataFrame) -> DataFrame:
    """Five aggregates for each requirement, each made before its join."""
    done = actions.where("action = 'shortlisted'").join(matches.select("match_id", "req_id"), "match_id")
    out = scalar_lookup(requirements, refs, "req_id", {"found": F.count("*"), "kept": F.count_if(F.col("state") == "passed")}, {"found": 0, "kept": 0})
    out = scalar_lookup(out, current_matches(matches), "req_id", {"ranked": F.count("*")}, {"ranked": 0})
    out = scalar_lookup(out, done, "req_id", {"shortlisted": F.count("*")}, {"shortlisted": 0})
    return scalar_lookup(out, runs, "req_id", {"last_run": F.max("run_at")})


def progress(jobs: DataFrame, as_of: Column, stall_seconds: int = 90) -> DataFrame:
    """For each requirement with an unfinished job: pending and stalled jobs, what it is doing, and for how long."""
    live = jobs.where(F.col("state").isin("queued", "running")).withColumn("req_id", F.get_json_object("payload", "$.role_id"))
    stalled = (F.col("state") == "queued") & (F.col("attempts") == 0) & (F.col("created_at") < as_of - F.make_dt_interval(secs=F.lit(stall_seconds)))
    return live.groupBy("req_id").agg(
        F.count("*").alias("pending"),
        F.count_if(stalled).alias("stalled"),
        F.coalesce(F.min(F.when(F.col("state") == "running", F.col("kind"))), F.min("kind")).alias("stage"),
        F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.min("created_at").cast("timestamp"))) / 1_000_000).cast("long").alias("age_s"),
    )


def role_progress(requirements: DataFrame, refs: DataFrame, matches: DataFrame, claims: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Numbers of each requirement's search: found and kept refs, people ranked and read, and its queue."""
    read = current_matches(matches).join(claims.select("subject_id").distinct(), "subject_id", "left_semi")
    out = scalar_lookup(requirements, refs, "req_id", {"found": F.count("*"), "kept": F.count_if(F.col("state") == "passed")}, {"found": 0, "kept": 0})
    out = scalar_lookup(out, read, "req_id", {"ranked": F.count("*")}, {"ranked": 0})
    queue = progress(jobs, as_of)
    return out.join(queue, "req_id", "left").fillna(0, ["pending", "stalled", "age_s"]).withColumn("doing", stage_name(F.col("stage")))


def degraded(requirements: DataFrame, matches: DataFrame, claims: DataFrame) -> DataFrame:
    """Requirements none of whose matches has computed years."""
    known = current_matches(matches).join(claims.where("claim_type = 'experience_years'").select("subject_id").distinct(), "subject_id", "left_semi").select("req_id").distinct()
    return requirements.select("req_id").join(known, "req_id", "left_anti")


def health(policies: DataFrame, fetches: DataFrame, as_of: Column) -> DataFrame:
    """Light of each source: red if disabled, amber if it never or lately did not succeed, else green."""
    ok = F.col("status").between(200, 299)
    week = F.col("fetched_at") >= as_of - F.make_dt_interval(days=F.lit(7))
    agg = fetches.groupBy("domain").agg(
        F.count("*").alias("ran"), F.count_if(ok).alias("succeeded"), F.count_if(ok & week).alias("lately"),
        F.max(F.when(ok, F.col("fetched_at"))).alias("last_success"), F.max_by(F.when(~ok, F.col("error")), F.when(~ok, F.struct("fetched_at", "fetch_id"))).alias("last_error"),
    )
    out = policies.join(agg, "domain", "left").fillna(0, ["ran", "succeeded", "lately"])
    light = F.when(~F.col("enabled"), "red").when((F.col("ran") == 0) | (F.col("succeeded") == 0) | (F.col("lately") == 0), "amber").otherwise("green")
    return out.withColumn("light", light)


def valid_actions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known actions, refused ones)."""
    good = F.coalesce(F.col("action").isin(ACTIONS), F.lit(False))
    return actions.where(good), actions.where(~good)


def yield_summary(rows: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    n, good = F.count("*"), F.count_if(condition)
    return rows.groupBy(*keys).agg(n.alias("n"), good.alias("good"), F.coalesce(F.try_divide(good, n), F.lit(0.0)).alias("yield"))


def search_cost(planned: Column, ran: Column, depth: Column) -> Column:
    """Queries that a search still takes: those it ran, and the others at one page deeper."""
    return ran + (planned - ran) * (depth + 1)


def search_depth(jobs: DataFrame, req: str, payload: str) -> DataFrame:
    """The deepest page that each requirement was searched to; payloads that name none count as 1."""
    pages = F.coalesce(F.get_json_object(payload, "$.pages").try_cast("int"), F.lit(1))
    return jobs.groupBy(req).agg(F.max(pages).alias("depth"))


def preflight(rules: list[tuple[Column, str]], count: Column, limit: Column) -> Column:
    """Struct of refusal and count: ordered refusals, else the count clamped to the limit."""
    out = None
    for when, text in rules:
        out = F.when(when, F.lit(text)) if out is None else out.when(when, F.lit(text))
    return F.struct(out.alias("refusal"), F.when(out.isNull(), F.greatest(F.lit(0), F.least(count, limit))).alias("count"))


def reading(off: Column, budget: Column, attached: Column, busy: Column, waiting: Column, limit: Column, picked: Column) -> Column:
    """Struct of refusal and count of a request to read: switched off, budget spent, no browser, busy or nobody left; else
    at least one and at most the limit (all of those picked by hand, where some were), those waiting and the budget."""
    asked = F.when(picked > 0, picked).otherwise(limit)
    left = F.when(picked > 0, picked).otherwise(waiting)
    out = F.when(off, "off").when(budget <= 0, "spent").when(~attached, "no-browser").when(busy, "busy").when(left <= 0, "nobody")
    return F.struct(out.alias("refusal"), F.when(out.isNull(), F.greatest(F.lit(1), F.least(asked, left, budget))).alias("count"))
