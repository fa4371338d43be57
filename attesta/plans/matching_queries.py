"""Scoring queries on the driver's tables: customers are subjects, order lines are claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import COMPONENTS
from ..operators.relational import union_years
from ..operators.scoring import active_weights, components, evaluate, ranked
from ..sources.readers import tables

REQ = "req_id string, profile string, titles array<string>, must_have array<string>, nice_to_have array<string>, min_years int, regions array<string>, remote string, max_staleness_days int"
AS_OF = "2001-12-31"
CAP = 100_000.0


def requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("r1", "tech", ["Backend Engineer"], ["Brand#6", "Brand#13"], ["Brand#24"], 2, ["ASIA", "EUROPE-FRANCE"], "hybrid", 540)], REQ)


def claims(t: dict[str, DataFrame]) -> DataFrame:
    """Claims of customers: brands of their order lines, place, years (union of order intervals), availability."""
    none = F.lit(None).cast("string")
    tier = F.when(F.col("o_orderstatus") == "F", "artifact_backed").when(F.col("o_orderstatus") == "O", "third_party_stated").otherwise("self_reported")
    lines = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("subject_id"), "o_orderdate", "l_partkey", "l_extendedprice", "l_quantity", tier.alias("tier"), "o_orderstatus")
    shape = lambda df, kind, key, value, num, tier_, at: df.select("subject_id", F.lit(kind).alias("claim_type"), key.alias("claim_key"), value.alias("claim_value"), num.cast("double").alias("value_num"), tier_.alias("tier"), at.cast("timestamp").alias("observed_at"))
    skill = shape(lines.join(t["part"], F.col("l_partkey") == F.col("p_partkey")), "skill", F.col("p_brand"), F.col("p_brand"), F.col("l_extendedprice"), F.col("tier"), F.col("o_orderdate"))
    homes = t["customer"].join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition
    said, never = F.lit("self_reported"), F.lit(None)
    place = shape(homes.select(F.col("c_custkey").alias("subject_id"), F.concat_ws("-", "r_name", "n_name").alias("code"), "n_name"), "location", F.col("code"), F.col("n_name"), never, said, never)
    spans = lines.select("subject_id", F.col("o_orderdate").cast("date").alias("s"), F.date_add(F.col("o_orderdate").cast("date"), F.col("l_quantity").cast("int")).alias("e"))
    years = shape(union_years(spans, "subject_id", "s", "e"), "experience_years", none, none, F.col("years"), said, never)
    ready = shape(t["orders"].where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("subject_id")).distinct(), "availability", none, none, never, said, never)
    return skill.unionByName(place).unionByName(years).unionByName(ready)


def _pairs(t: dict[str, DataFrame]) -> DataFrame:
    """The one search has found all customers that have a number."""
    return t["customer"].select(F.when(F.col("c_custkey").isNotNull(), "r1").alias("req_id"), F.col("c_custkey").alias("subject_id"))


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def shortlist_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    scored = evaluate(requirements(spark), claims(t), _as_of(), _pairs(t), depth_cap=CAP)
    return ranked(scored, "req_id").select("req_id", "subject_id", *COMPONENTS, "score", "gate_must_have", "gate_location", "gate_activity", "passed", "label", "rank")


def component_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    rows = components(requirements(spark), claims(t), _as_of(), _pairs(t), depth_cap=CAP)
    return rows.select("subject_id", "seniority_basis", *COMPONENTS)


def weighted_profile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under the newest active weights of a profile."""
    w = spark.createDataFrame([(1, "tech", "v0", True, 0.1, 0.1, 0.1, 0.1, 0.6), (2, "tech", "v1", True, 0.4, 0.2, 0.2, 0.2, 0.0), (3, "tech", "v2", False, 1.0, 0.0, 0.0, 0.0, 0.0)], "weights_id int, profile string, version string, active boolean, " + ", ".join(f"w_{c} double" for c in COMPONENTS))
    t = tables(spark, sf_dir)
    out = evaluate(requirements(spark), claims(t), _as_of(), _pairs(t), active_weights(w), depth_cap=CAP)
    return out.select("subject_id", "weights_version", "score")


_BASE = f"""
WITH lines AS (SELECT o_custkey AS s, o_orderdate AS ts, o_orderstatus AS st, l_partkey, l_extendedprice AS price, CAST(l_quantity AS INTEGER) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
skill AS (SELECT s, p_brand AS k, price, st, ts FROM lines JOIN part ON l_partkey = p_partkey),
iv AS (SELECT s, CAST(ts AS DATE) AS a, CAST(ts AS DATE) + q AS b FROM lines),
iw AS (SELECT s, a, b, max(b) OVER (PARTITION BY s ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv),
yrs AS (SELECT s, floor(sum(CASE WHEN r IS NULL OR a > r THEN b - a WHEN b > r THEN b - r ELSE 0 END) / 365.25::DOUBLE * 10) / 10 AS y FROM iw GROUP BY s),
home AS (SELECT c_custkey AS s, r_name || '-' || n_name AS code FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
act AS (SELECT s, max(ts) FILTER (WHERE st = 'F') AS latest FROM skill GROUP BY s),
avail AS (SELECT DISTINCT o_custkey AS s FROM orders WHERE o_orderstatus = 'P'),
want AS (SELECT * FROM (VALUES ('Brand#6', 1.0::DOUBLE, true), ('Brand#13', 1.0::DOUBLE, true), ('Brand#24', 0.4::DOUBLE, false)) w(k, w, must)),
held AS (SELECT s, skill.k, w, must, sum(price) FILTER (WHERE st = 'F') AS vol, max(ts) FILTER (WHERE st = 'F') AS newest FROM skill JOIN want ON skill.k = want.k GROUP BY ALL),
agg AS (SELECT s, sum(w) AS earned,
   sum(CASE WHEN must AND newest IS NOT NULL THEN (CASE WHEN vol > 0 THEN least(1.0, ln(1 + vol) / ln(1 + {CAP}::DOUBLE)) ELSE 0 END) * pow(0.5, greatest(0.0, date_diff('day', newest, TIMESTAMP '{AS_OF}')::DOUBLE) / 365.0) ELSE 0 END) AS dsum,
   count(*) FILTER (WHERE must) AS n_must, bool_or(k = 'Brand#6') AS h6, bool_or(k = 'Brand#13') AS h13 FROM held GROUP BY s),
comp AS (SELECT home.s AS subject_id, code, latest, coalesce(n_must, 0) AS n_must, coalesce(h6, false) AS h6, coalesce(h13, false) AS h13, y,
   round(least(1.0, greatest(0.0, coalesce(earned, 0) / 2.4::DOUBLE)), 6) AS skill_match, round(least(1.0, greatest(0.0, coalesce(dsum, 0) / 2)), 6) AS skill_depth,
   round(CASE WHEN coalesce(y, date_diff('day', latest, TIMESTAMP '{AS_OF}')) IS NULL THEN 0.0 WHEN y >= 2 THEN 1.0 ELSE greatest(0.0, 1.0 - (2 - y) / 4.0::DOUBLE) END, 6) AS seniority_fit,
   round(CASE WHEN latest IS NULL THEN 0.0 ELSE pow(0.5, greatest(0.0, date_diff('day', latest, TIMESTAMP '{AS_OF}')::DOUBLE) / 365.0) END, 6) AS activity_recency,
   CASE WHEN avail.s IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS availability
 FROM home LEFT JOIN act USING (s) LEFT JOIN agg USING (s) LEFT JOIN yrs USING (s) LEFT JOIN avail USING (s))
"""
_SCORE = "round((0.2 * skill_match + 0.2 * skill_depth + 0.2 * seniority_fit + 0.2 * activity_recency + 0.2 * availability)::DOUBLE * CASE WHEN n_must = 0 THEN 0.25::DOUBLE ELSE 1 END, 6)"

QUERIES = {
    "shortlist_scored": (shortlist_scored, _BASE + f""", sc AS (SELECT *, {_SCORE} AS score FROM comp)
SELECT 'r1' AS req_id, subject_id, skill_match, skill_depth, seniority_fit, activity_recency, availability, score,
  CASE n_must WHEN 2 THEN 'pass' ELSE 'pass: has ' || n_must || ' of 2; no evidence for ' || concat_ws(', ', CASE WHEN NOT h6 THEN 'Brand#6' END, CASE WHEN NOT h13 THEN 'Brand#13' END) END AS gate_must_have,
  CASE WHEN starts_with(code, 'ASIA') OR starts_with(code, 'EUROPE-FRANCE') THEN 'pass' ELSE 'pass: ' || code || ' is outside ASIA, EUROPE-FRANCE — would need to relocate' END AS gate_location,
  CASE WHEN latest IS NULL THEN 'skip: no artefact evidence' WHEN date_diff('day', latest, TIMESTAMP '{AS_OF}') <= 540 THEN 'pass' ELSE 'fail: most recent public work ' || date_diff('day', latest, TIMESTAMP '{AS_OF}') || ' days old, limit 540' END AS gate_activity,
  NOT coalesce(date_diff('day', latest, TIMESTAMP '{AS_OF}') > 540, false) AS passed,
  CASE WHEN score >= 0.55 THEN 'Strong match' WHEN score >= 0.40 THEN 'Good match' WHEN score >= 0.25 THEN 'Possible match' ELSE 'Weak' END AS label,
  row_number() OVER (ORDER BY score DESC, subject_id) AS rank FROM sc"""),
    "component_breakdown": (component_breakdown, _BASE + "SELECT subject_id, CASE WHEN y IS NOT NULL THEN 'computed' WHEN latest IS NOT NULL THEN 'estimated' ELSE 'unknown' END AS seniority_basis, skill_match, skill_depth, seniority_fit, activity_recency, availability FROM comp"),
    "weighted_profile_join": (weighted_profile_join, _BASE + "SELECT subject_id, 'v1' AS weights_version, round((0.4 * skill_match + 0.2 * skill_depth + 0.2 * seniority_fit + 0.2 * activity_recency + 0.0 * availability)::DOUBLE * CASE WHEN n_must = 0 THEN 0.25::DOUBLE ELSE 1 END, 6) AS score FROM comp"),
}
