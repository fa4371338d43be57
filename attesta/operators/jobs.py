"""The data side of a job queue, fetch policy and sessions, as functions of an event log and a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import NOTE_CHARS
from .relational import first_wins, null_safe

LEASE_MINUTES, ATTEMPTS = 15, 3


def payload_hash(kind: Column, payload: Column) -> Column:
    """Digest of a job's kind and JSON payload: keys sorted at every level, values with their types, no white space."""
    body = F.to_json(F.try_parse_json(payload))  # a variant keeps the fields of an object in the order of their names
    return F.sha2(F.concat(F.lit('{"kind":"'), kind, F.lit('","payload":'), body, F.lit("}")), 256)


def enqueue(jobs: DataFrame, asked: DataFrame, order: list[Column]) -> DataFrame:
    """Asked jobs without an unfinished one of the same kind and payload; repeats in one batch count once."""
    new = first_wins(asked.withColumn("payload_hash", payload_hash(F.col("kind"), F.col("payload"))), ["payload_hash"], order)
    return null_safe(new, jobs.where(F.col("state").isin("queued", "running")), ["payload_hash"], "left_anti")


def reap(jobs: DataFrame, as_of: Column, minutes: int = LEASE_MINUTES, attempts: int = ATTEMPTS) -> DataFrame:
    """Running jobs past their lease go back to the queue, or fail after the last attempt."""
    late = (F.col("state") == "running") & (F.col("locked_at") < as_of - F.make_dt_interval(mins=F.lit(minutes)))
    state = F.when(late & (F.col("attempts") >= attempts), "failed").when(late, "queued").otherwise(F.col("state"))
    return jobs.withColumn("last_error", F.when(late, F.coalesce("last_error", F.lit("lease expired"))).otherwise(F.col("last_error"))).withColumn("state", state)


def finish(jobs: DataFrame, outcomes: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Outcomes (id, ok, error) applied: done, or queued again, or failed after the last attempt."""
    j = jobs.join(outcomes.select("id", "ok", F.col("error").alias("_error")), "id", "left")
    state = F.when(F.col("ok").isNull(), F.col("state")).when(F.col("ok"), "done").when(F.col("attempts") >= attempts, "failed").otherwise("queued")
    return j.withColumn("state", state).withColumn("last_error", F.coalesce("_error", "last_error")).drop("ok", "_error")


def stop(jobs: DataFrame, ids: DataFrame, why: str = "stopped") -> DataFrame:
    """Unfinished jobs of the ids end as stopped."""
    hit = F.col("_stop").isNotNull() & F.col("state").isin("queued", "running")
    j = jobs.join(ids.select("id", F.lit(True).alias("_stop")).distinct(), "id", "left")
    return j.withColumn("last_error", F.when(hit, F.lit(why)).otherwise(F.col("last_error"))).withColumn("state", F.when(hit, "stopped").otherwise(F.col("state"))).drop("_stop")


def next_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """Oldest queued jobs: a top-k report."""
    return jobs.where("state = 'queued'").orderBy("created_at", "id").limit(n)


def state_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("n"))


def pending(jobs: DataFrame, kinds: DataFrame) -> DataFrame:
    """For each kind, whether a job of it waits or runs anywhere."""
    live = jobs.where(F.col("state").isin("queued", "running")).select("kind", F.lit(True).alias("pending")).distinct()
    return kinds.select("kind").join(live, "kind", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))


def noted(jobs: DataFrame, notes: DataFrame) -> DataFrame:
    """Jobs with their newest note (id, note, noted_at), cut to what the column holds; of notes of one time, the greatest.

    Newest times are found first, from ids and times alone, so that notes are sorted only where they are joined; they are
    cut before, as the greatest note begins with the greatest beginning.
    """
    newest = notes.groupBy("id").agg(F.max("noted_at").alias("_newest"))
    cut = notes.select(F.col("id").alias("_id"), F.col("noted_at").alias("_at"), F.substring("note", 1, NOTE_CHARS).alias("note"))
    last = cut.join(newest, (F.col("_id") == F.col("id")) & F.col("_at").eqNullSafe(F.col("_newest"))).groupBy("id").agg(F.max("note").alias("note"))
    return jobs.join(last, "id", "left")


def also_affected(refs: DataFrame, read: DataFrame) -> DataFrame:
    """(req_id): the other requirements that hold people of ``read`` (req_id, subject_id), once each."""
    hit = refs.where("subject_id IS NOT NULL").select("req_id", "subject_id").join(read.select(F.col("req_id").alias("_own"), "subject_id"), "subject_id")
    return hit.where("req_id <> _own").select(F.col("_own").alias("read_for"), "req_id").distinct()


def policy_reason(has_row: Column, enabled: Column, reason: Column) -> Column:
    return F.when(~has_row, "no policy for this source").when(~enabled, F.coalesce(reason, F.lit("disabled")))


def budget(cap: Column, spent: Column) -> Column:
    return F.greatest(F.lit(0), cap - spent)


def outcome(status: Column, error: Column, transient: list[str]) -> Column:
    """Class of a fetch: ok, retry (5xx or a transient error) or fail."""
    again = (status >= 500) | F.coalesce(F.exists(F.array(*map(F.lit, transient)), lambda m: F.contains(F.lower(error), m)), F.lit(False))
    return F.when(status.between(200, 299), "ok").when(again, "retry").otherwise("fail")


def kill(policies: DataFrame, domain: str, why: str) -> DataFrame:
    hit = F.col("domain") == domain
    return policies.withColumn("reason", F.when(hit, F.lit(why)).otherwise(F.col("reason"))).withColumn("enabled", F.col("enabled") & ~hit)


def live_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > as_of)


def cached(fetches: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """The newest successful fetch of each URL digest within the hours."""
    fresh = fetches.where(F.col("status").between(200, 299) & (F.col("fetched_at") > as_of - F.make_dt_interval(hours=F.lit(hours))))
    return fresh.groupBy("url_hash").agg(F.max_by(F.struct("fetch_id", "body_path", "fetched_at"), F.struct("fetched_at", "fetch_id")).alias("hit")).select("url_hash", "hit.*")


def ruled_out(roles: DataFrame, refs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(req_id, passed, rejected, jobs, last_finished): refs of each role by gate, its jobs, and when the last one ended.

    Each fact table is counted once before its join; roles without refs or jobs count 0.
    """
    counts = refs.groupBy("req_id").agg(F.count_if(F.col("gate_state") == "passed").alias("passed"), F.count_if(F.col("gate_state") == "rejected").alias("rejected"))
    ended = jobs.groupBy("req_id").agg(F.count("*").alias("jobs"), F.max(F.when(F.col("state").isin("done", "failed"), F.col("finished_at"))).alias("last_finished"))
    return roles.select("req_id").join(counts, "req_id", "left").join(ended, "req_id", "left").fillna(0, ["passed", "rejected", "jobs"])
