"""Identities on strong keys only: resolve, merge, unmerge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import null_safe

NEW_KEY = "concat('s-', substring(sha2(source_id, 256), 1, 16))"


def resolve(keys: DataFrame, identities: DataFrame, kinds: list[str] = ()) -> DataFrame:
    """(source_id, outcome, subject_id, candidates): none without keys, create on no match, attach on one, review on more.

    ``kinds`` names the kinds that count as strong (all, if none are named).
    """
    clean = keys.where("coalesce(trim(value), '') <> ''").where(F.col("kind").isin(list(kinds)) if kinds else F.lit(True)).select("source_id", "kind", F.trim("value").alias("value")).distinct()
    seen = clean.join(identities.select("kind", "value", "subject_id"), ["kind", "value"], "left").groupBy("source_id").agg(F.array_sort(F.collect_set("subject_id")).alias("candidates"))
    out = keys.select("source_id").distinct().join(seen, "source_id", "left")
    n = F.size("candidates")
    outcome = F.when(F.col("candidates").isNull(), "none").when(n == 0, "create").when(n == 1, "attach").otherwise("review")
    return out.select("source_id", outcome.alias("outcome"), F.when(n == 1, F.col("candidates")[0]).when(n == 0, F.expr(NEW_KEY)).alias("subject_id"), "candidates")


def merge(identities: DataFrame, claims: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(identities, claims, journal) after subjects move from ``from_id`` to ``into_id``.

    Claims that would collide with one of the target stay; so do all but the first (by from_id, then claim) of those
    that would collide with each other there. The journal lists what moved, so that unmerge is exact.
    """
    m = merges.select("from_id", "into_id").distinct()
    key = ["into_id", "claim_type", "claim_key", "source_url"]
    moved_ids = identities.join(m, identities.subject_id == m.from_id)
    ids = identities.join(m, identities.subject_id == m.from_id, "left").select("identity_id", F.coalesce("into_id", "subject_id").alias("subject_id"), "kind", "value")
    own = claims.join(m, claims.subject_id == m.from_id)
    target = claims.select(F.col("subject_id").alias("into_id"), "claim_type", "claim_key", "source_url")
    free = null_safe(own, target, key, "left_anti").groupBy(*key).agg(F.min(F.struct("from_id", "claim_id")).alias("m")).select("m.claim_id", "m.from_id", "into_id")
    out = claims.join(free.select("claim_id", "into_id"), "claim_id", "left").withColumn("subject_id", F.coalesce("into_id", "subject_id")).select(claims.columns)
    a = moved_ids.groupBy("from_id", "into_id").agg(F.array_sort(F.collect_list("identity_id")).alias("identity_ids"))
    b = free.groupBy("from_id", "into_id").agg(F.array_sort(F.collect_list("claim_id")).alias("claim_ids"))
    return ids, out, m.join(a, ["from_id", "into_id"], "left").join(b, ["from_id", "into_id"], "left")


def unmerge(identities: DataFrame, claims: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state before the journal's merges."""
    i = journal.select(F.explode("identity_ids").alias("identity_id"), "from_id")
    c = journal.select(F.explode("claim_ids").alias("claim_id"), "from_id")
    back = lambda df, ids, key: df.join(ids, key, "left").withColumn("subject_id", F.coalesce("from_id", "subject_id")).select(df.columns)
    return back(identities, i, "identity_id"), back(claims, c, "claim_id")


def strong_key_map(identities: DataFrame) -> DataFrame:
    """(subject_id, keys): one value for each kind, the least."""
    one = identities.groupBy("subject_id", "kind").agg(F.min("value").alias("value"))
    return one.groupBy("subject_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "value")))).alias("keys"))


def link_refs(refs: DataFrame, identities: DataFrame) -> DataFrame:
    """Profile refs without a subject take that of the identity of their slug."""
    slugs = identities.where("kind = 'linkedin_slug'").select(F.concat(F.lit("linkedin.com/in/"), F.lower("value")).alias("ref_value"), F.lit("linkedin_url").alias("ref_kind"), F.col("subject_id").alias("_subject"))
    return refs.join(slugs, ["ref_kind", "ref_value"], "left").withColumn("subject_id", F.coalesce("subject_id", "_subject")).select(refs.columns)


REVIEW = "multiple candidates hold strong keys from the same source"  # a fixed text


def propose(resolved: DataFrame) -> DataFrame:
    """Open reviews of sources whose keys name several subjects; nothing is merged."""
    c = F.col("candidates")
    return resolved.where("outcome = 'review'").select("source_id", c[0].alias("subject_a"), c[1].alias("subject_b"), F.lit(REVIEW).alias("reason"), F.to_json(F.struct(c.alias("all_matched"))).alias("evidence"), F.lit("open").alias("status"))


def open_reviews(reviews: DataFrame, order: str = "source_id") -> DataFrame:
    return reviews.where("status = 'open'").orderBy(order)
