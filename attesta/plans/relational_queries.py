"""Relational archetypes on the driver's tables, each with an independent DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timefn
from ..operators import gate, identity, jobs, relational as R, reports
from .registry import Registry

QUERIES = Registry()
query = QUERIES.query


def _ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


DAY = "2024-01-20 00:00:00"


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(t):
    return R.latest_per_key(t["events"], ["user_id"], [F.col("ts").desc_nulls_last(), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""
WITH e AS (SELECT user_id, nullif(event_type, 'view') AS k, event_id, value, props, event_id % 2 AS n FROM events)
SELECT user_id, k, arg_max(value, n * 10000000000 + event_id) AS value, arg_min(props, n * 10000000000 + event_id) AS props, arg_min(event_id, n * 10000000000 + event_id) AS event_id FROM e GROUP BY user_id, k""")
def upsert_latest_null_safe(t):
    e = t["events"].select("user_id", F.nullif(F.col("event_type"), F.lit("view")).alias("k"), "event_id", "value", "props")
    return R.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "k"], ["event_id"], ["value"])


@query(f"""
WITH a AS (SELECT user_id, event_type, event_id FROM events WHERE ts < TIMESTAMP '{DAY}' AND event_type <> 'purchase'),
b AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '{DAY}' GROUP BY ALL)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_type = b.event_type)""")
def insert_ignore(t):
    e = t["events"].select("user_id", "event_type", "event_id", "ts")
    day = F.lit(DAY).cast("timestamp_ntz")
    old = e.where((F.col("ts") < day) & (F.col("event_type") != "purchase")).drop("ts")
    return R.insert_ignore(old, e.where(F.col("ts") >= day).drop("ts"), ["user_id", "event_type"], [F.asc("event_id")])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def anti_not_on_requirement(t):
    own = t["orders"].where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return t["customer"].join(own, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_has_claim(t):
    return t["customer"].join(t["orders"].where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("""SELECT n_nationkey, n_name, coalesce((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey), 0) AS found,
coalesce((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0), 0) AS kept,
coalesce((SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey), 0) AS ranked,
coalesce((SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_orderstatus = 'F'), 0) AS shortlisted,
(SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS last_run FROM nation""")
def overview_correlated(t):
    c = t["customer"].withColumnRenamed("c_nationkey", "n_nationkey")
    o = t["orders"].join(c.select("c_custkey", "n_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    out = R.scalar_lookup(t["nation"].select("n_nationkey", "n_name"), c, "n_nationkey", {"found": F.count("*"), "kept": F.count_if(F.col("c_acctbal") > 0)}, {"found": 0, "kept": 0})
    aggs = {"ranked": F.count("*"), "shortlisted": F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))), "last_run": F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")}
    return R.scalar_lookup(out, o, "n_nationkey", aggs, {"ranked": 0, "shortlisted": 0})


@query("SELECT c_custkey, (SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_action FROM customer")
def last_action_top1(t):
    last = t["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_action"))
    return t["customer"].select("c_custkey").join(last, "c_custkey", "left")


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS kept, count(*) FILTER (WHERE value > 50) AS ranked,
coalesce(min(event_type) FILTER (WHERE value > 99), min(event_type) FILTER (WHERE value > 90)) AS stage FROM events GROUP BY user_id""")
def progress_filtered_aggs(t):
    kind, v = F.col("event_type"), F.col("value")
    return t["events"].groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(kind == "purchase").alias("kept"), F.count_if(v > 50).alias("ranked"), F.coalesce(F.min(F.when(v > 99, kind)), F.min(F.when(v > 90, kind))).alias("stage"))


@query("""WITH v AS (SELECT l_suppkey AS s, p_brand, round(sum(l_extendedprice), 2) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT s, p_brand, volume, rank FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY volume DESC, p_brand) AS rank FROM v) WHERE rank <= 3""")
def topk_per_subject(t):
    v = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("s"), "p_brand").agg(F.round(F.sum("l_extendedprice"), 2).alias("volume"))
    return R.top_k(v, ["s"], [F.desc("volume"), F.asc("p_brand")], 3).select("s", "p_brand", "volume", F.col("rank").cast("long").alias("rank"))


@query("""WITH p AS (SELECT l_orderkey, l_partkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_partkey, round(share, 6) AS share FROM (SELECT *, v / sum(v) OVER (PARTITION BY l_orderkey) AS share FROM p) WHERE share >= 0.1""")
def share_of_group(t):
    p = t["lineitem"].groupBy("l_orderkey", "l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    return R.share_of_group(p, ["l_orderkey"], "v", 0.1).select("l_orderkey", "l_partkey", F.round("share", 6).alias("share"))


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderpriority, o_orderkey) AS place, o_orderkey FROM orders""")
def tier_split_sort(t):
    return R.flagged_first(t["orders"], ["o_custkey"], F.col("o_orderstatus") == "F", [F.asc("o_orderpriority"), F.asc("o_orderkey")]).select("o_custkey", "place", "o_orderkey")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal > 6000 AS strict, c_acctbal > 2000 AS loose FROM customer),
s AS (SELECT *, count(*) FILTER (WHERE strict) OVER (PARTITION BY c_nationkey) AS kept, count(*) OVER (PARTITION BY c_nationkey) AS n FROM c)
SELECT c_custkey, strict OR (kept / n < 0.5 AND loose) AS passed, NOT strict AND kept / n < 0.5 AND loose AS rescued,
CASE WHEN strict THEN NULL WHEN kept / n < 0.5 AND loose THEN 'admitted: the job-title filter refused ' || (n - kept) || ' of ' || n || ' people this search found, so it is not being trusted for this role — check the headline' ELSE 'balance: under 6000' END AS reason FROM s""")
def rescue_threshold(t):
    verdict = lambda limit: gate.ordered_gate([(F.col("c_acctbal") <= limit, F.concat(F.lit("balance: under "), F.lit(limit)))])
    rows = t["customer"].select("c_custkey", "c_nationkey", verdict(6000).alias("strict"), verdict(2000).alias("loose"))
    return gate.rescue(rows, "c_nationkey", "strict", "loose").select("c_custkey", F.col("verdict.passed").alias("passed"), "rescued", F.col("verdict.reason").alias("reason"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'passed' ELSE 'failed' END AS old_state, CASE WHEN c_acctbal > 3000 AND c_mktsegment <> 'BUILDING' THEN 'passed' ELSE 'failed' END AS new_state,
CASE WHEN c_acctbal <= 3000 THEN 'balance: low' WHEN c_mktsegment = 'BUILDING' THEN 'segment: excluded' END AS reason FROM customer) SELECT * FROM c WHERE old_state <> new_state""")
def regate_diff(t):
    old = t["customer"].select("c_custkey", F.when(F.col("c_acctbal") > 5000, "passed").otherwise("failed").alias("state"))
    verdict = gate.ordered_gate([(F.col("c_acctbal") <= 3000, F.lit("balance: low")), (F.col("c_mktsegment") == "BUILDING", F.lit("segment: excluded"))])
    return gate.regate(old, t["customer"].select("c_custkey", verdict.alias("verdict")), "c_custkey")


_CHAIN = """WITH g AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'title: ' || c_mktsegment || ' does not match' WHEN c_acctbal < 0 THEN 'employer: excluded' WHEN r_name = 'AFRICA' THEN 'location: ' || n_name || ' is outside' END AS fail,
CASE WHEN r_name <> 'ASIA' THEN 'location: ' || n_name || ' would need to relocate' END AS note FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) """


def _chain(t):
    c = t["customer"].join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition
    rules = [
        (F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("title: "), "c_mktsegment", F.lit(" does not match"))),
        (F.col("c_acctbal") < 0, F.lit("employer: excluded")),
        (F.col("r_name") == "AFRICA", F.concat(F.lit("location: "), "n_name", F.lit(" is outside"))),
    ]
    v = gate.ordered_gate(rules, F.when(F.col("r_name") != "ASIA", F.concat(F.lit("location: "), "n_name", F.lit(" would need to relocate"))))
    return c.select("c_custkey", v["passed"].alias("passed"), v["reason"].alias("reason"))


@query(_CHAIN + "SELECT c_custkey, fail IS NULL AS passed, coalesce(fail, note) AS reason FROM g")
def gate_reason_chain(t):
    return _chain(t)


@query(_CHAIN + "SELECT split_part(fail, ':', 1) AS kind, count(*) AS n FROM g WHERE fail IS NOT NULL GROUP BY 1")
def gate_reason_histogram(t):
    return gate.reason_histogram(_chain(t).where("NOT passed"), "reason")


@query("""WITH s AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(l_quantity AS INTEGER) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
w AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s)
SELECT k, CAST(sum(CASE WHEN r IS NULL OR a > r THEN b - a WHEN b > r THEN b - r ELSE 0 END) AS BIGINT) AS days, floor(sum(CASE WHEN r IS NULL OR a > r THEN b - a WHEN b > r THEN b - r ELSE 0 END) / 365.25::DOUBLE * 10) / 10 AS years FROM w GROUP BY k""")
def interval_union_years(t):
    day = F.col("o_orderdate").cast("date")
    s = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("k"), day.alias("a"), F.date_add(day, F.col("l_quantity").cast("int")).alias("b"))
    return R.union_years(s, "k", "a", "b")


@query("SELECT o_custkey, round(pow(0.5, greatest(0.0, date_diff('day', max(o_orderdate), TIMESTAMP '2001-12-31')::DOUBLE) / 365.0), 6) AS recency FROM orders GROUP BY 1")
def decay_recency(t):
    as_of = F.lit("2001-12-31").cast("timestamp")
    return t["orders"].groupBy("o_custkey").agg(F.max("o_orderdate").alias("m")).select("o_custkey", F.round(timefn.decay(timefn.days_between(as_of, F.col("m"))), 6).alias("recency"))


@query("SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rolling_24h_cap(t):
    return R.rolling_count(t["events"].select("event_id", "event_type", "ts"), ["event_type"], "ts", 24, "event_id").select("event_id", "event_type", "in_window")


@query(f"SELECT event_type, count(*) AS spent, strftime(min(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS frees_at FROM events WHERE ts > TIMESTAMP '{DAY}' - INTERVAL 12 HOUR AND ts <= TIMESTAMP '{DAY}' GROUP BY 1")
def window_frees_at(t):
    return R.window_frees_at(t["events"].select("event_type", "ts"), ["event_type"], "ts", F.lit(DAY).cast("timestamp_ntz"), 12).select("event_type", "spent", _ts("frees_at"))


@query(f"""WITH j AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'done' END AS state, CAST(event_id % 5 AS INTEGER) AS attempts, ts FROM events)
SELECT id, CASE WHEN state = 'running' AND ts < TIMESTAMP '{DAY}' - INTERVAL 15 MINUTE THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE state END AS state,
CASE WHEN state = 'running' AND ts < TIMESTAMP '{DAY}' - INTERVAL 15 MINUTE THEN 'lease expired' END AS last_error FROM j""")
def lease_reap_state(t):
    j = t["events"].select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "queued").otherwise("done").alias("state"),
        (F.col("event_id") % 5).cast("int").alias("attempts"), F.col("ts").alias("locked_at"), F.lit(None).cast("string").alias("last_error"),
    )
    return jobs.reap(j, F.lit(DAY).cast("timestamp_ntz")).select("id", "state", "last_error")


@query(f"""WITH p AS (SELECT DISTINCT event_type AS domain, event_type <> 'error' AS enabled FROM events),
f AS (SELECT event_type AS domain, strftime(max(ts) FILTER (WHERE value > 99.9), '%Y-%m-%d %H:%M:%S') AS last_success, arg_max(props, (ts, event_id)) FILTER (WHERE value <= 99.9) AS last_error, count(*) AS ran, count(*) FILTER (WHERE value > 99.9) AS succeeded, count(*) FILTER (WHERE value > 99.9 AND ts >= TIMESTAMP '{DAY}' - INTERVAL 7 DAY) AS lately FROM events GROUP BY 1)
SELECT domain, ran, succeeded, lately, last_success, last_error, CASE WHEN NOT enabled THEN 'red' WHEN ran = 0 OR succeeded = 0 OR lately = 0 THEN 'amber' ELSE 'green' END AS light FROM p JOIN f USING (domain)""")
def health_light(t):
    e = t["events"]
    p = e.select(F.col("event_type").alias("domain"), (F.col("event_type") != "error").alias("enabled")).distinct()
    f = e.select(F.col("event_type").alias("domain"), F.when(F.col("value") > 99.9, 200).otherwise(500).alias("status"), F.col("ts").alias("fetched_at"), F.col("props").alias("error"), F.col("event_id").alias("fetch_id"))
    return reports.health(p, f, F.lit(DAY).cast("timestamp_ntz")).select("domain", "ran", "succeeded", "lately", _ts("last_success"), "last_error", "light")


@query("""WITH o AS (SELECT o_custkey, max(o_totalprice) AS best FROM orders WHERE o_custkey % 7 > 0 GROUP BY 1)
SELECT CASE WHEN o_custkey IS NULL THEN 'unchecked' WHEN best > 250000 THEN 'ranked' ELSE 'ruled_out' END AS bucket, count(*) AS n FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1""")
def bucket_split(t):
    o = t["orders"].where("o_custkey % 7 > 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    bucket = F.when(F.col("best").isNull(), "unchecked").when(F.col("best") > 250000, "ranked").otherwise("ruled_out")
    return t["customer"].select("c_custkey").join(o, "c_custkey", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT doc_id AS source_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE md5(text) END AS v FROM documents), i AS (SELECT DISTINCT md5(text) AS v, source AS s FROM documents WHERE doc_id % 3 = 0),
m AS (SELECT source_id, count(DISTINCT s) AS n, min(s) AS s, bool_or(v <> '') AS has FROM k LEFT JOIN i USING (v) GROUP BY 1)
SELECT source_id, CASE WHEN NOT has THEN 'none' WHEN n = 0 THEN 'create' WHEN n = 1 THEN 'attach' ELSE 'review' END AS outcome, CASE WHEN has AND n = 1 THEN s WHEN has AND n = 0 THEN 's-' || substr(sha256(CAST(source_id AS VARCHAR)), 1, 16) END AS subject_id FROM m""")
def identity_resolve_0_1_n(t):
    d = t["documents"].select("doc_id", "source", F.md5("text").alias("v"))
    keys = d.select(F.col("doc_id").cast("string").alias("source_id"), F.lit("digest").alias("kind"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("v")).alias("value"))
    known = d.where("doc_id % 3 = 0").select(F.lit("digest").alias("kind"), F.col("v").alias("value"), F.col("source").alias("subject_id")).distinct()
    return identity.resolve(keys, known).select(F.col("source_id").cast("long").alias("source_id"), "outcome", "subject_id")


@query("""WITH c AS (SELECT c_custkey AS id, c_nationkey AS s, c_custkey % 97 AS k, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 97 ORDER BY c_custkey) AS nth FROM customer)
SELECT id AS claim_id, CAST(CASE WHEN s < 5 AND nth = 1 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.s = c.s + 10 AND b.k = c.k) THEN s + 10 ELSE s END AS VARCHAR) AS merged, CAST(s AS VARCHAR) AS restored FROM c""")
def merge_split_unmerge(t):
    subject, key = F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 97).cast("string")
    claims = t["customer"].select(F.col("c_custkey").alias("claim_id"), subject.alias("subject_id"), F.lit("skill").alias("claim_type"), key.alias("claim_key"), F.lit("t").alias("source_url"))
    ids = t["customer"].select(F.col("c_custkey").alias("identity_id"), subject.alias("subject_id"), F.lit("cust").alias("kind"), F.col("c_custkey").cast("string").alias("value"))
    merges = t["nation"].where("n_nationkey < 5").select(F.col("n_nationkey").cast("string").alias("from_id"), (F.col("n_nationkey") + 10).cast("string").alias("into_id"))
    _, moved, journal = identity.merge(ids, claims, merges)
    _, back = identity.unmerge(ids, moved, journal)
    return moved.select("claim_id", F.col("subject_id").alias("merged")).join(back.select("claim_id", F.col("subject_id").alias("restored")), "claim_id")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def ordered_first_wins(t):
    return R.first_wins(t["documents"].select("doc_id", F.md5("text").alias("h")), ["h"], [F.asc("doc_id")]).select("doc_id")


@query("""WITH x AS (SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE '*' END AS domain FROM documents) SELECT doc_id, CASE domain WHEN 'en' THEN 10 WHEN 'de' THEN 20 ELSE 5 END AS cap FROM x""")
def wildcard_policy_join(t):
    spark = t["documents"].sparkSession
    policy = spark.createDataFrame([("en", "web", 10), ("de", "web", 20), ("*", "web", 5)], "domain string, adapter string, cap int")
    rows = t["documents"].select("doc_id", F.col("lang").alias("domain"), F.lit("web").alias("adapter"))
    return R.wildcard_join(rows, policy, "domain", "adapter", "cap").select("doc_id", "cap")


@query("""SELECT event_id, sha256('{"kind":"' || event_type || '","payload":{"a":{"x":"' || user_id || '","y":[1,true,null]},"k":' || CASE WHEN event_id % 2 = 0 THEN '"' ELSE '' END || CAST(json_extract(props, '$.k') AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '"' ELSE '' END || '}}') AS payload_hash FROM events""")
def payload_hash(t):
    """Keys in another order at both levels, white space, and numbers that differ from strings of the same digits."""
    k, quote = F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 2 == 0, '"').otherwise("")
    body = F.concat(F.lit('{ "k" : '), quote, k, quote, F.lit(', "a" : {"y": [1, true, null], "x": "'), F.col("user_id").cast("string"), F.lit('"} }'))
    return t["events"].select("event_id", jobs.payload_hash(F.col("event_type"), body).alias("payload_hash"))


@query("SELECT user_id, max(coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 1)) AS depth FROM events GROUP BY 1")
def json_field_depth(t):
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(1))
    return t["events"].groupBy("user_id").agg(F.max(k).alias("depth"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN NULL WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM conversations""")
def carry_forward_group(t):
    c = t["conversations"].select("conv_id", "turn", F.when(F.col("role") == "user", F.char_length("text").cast("long")).alias("v"))
    return R.carry_forward(c, ["conv_id"], ["turn"], F.col("v"), "carried").select("conv_id", "turn", "carried")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 75) AS good, coalesce(count(*) FILTER (WHERE value > 75) / count(*), 0) AS yield FROM events GROUP BY 1")
def yield_summary(t):
    return reports.yield_summary(t["events"], ["event_type"], F.col("value") > 75)


@query("""WITH j AS (SELECT event_id AS id, event_type AS kind, user_id AS u, CAST(json_extract(props, '$.k') AS INTEGER) % 5 AS k FROM events), open AS (SELECT DISTINCT kind, u, k FROM j WHERE id % 4 = 0 AND id % 8 = 0)
SELECT kind, u, k, min(id) AS id FROM j WHERE id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM open o WHERE o.kind = j.kind AND o.u = j.u AND o.k = j.k) GROUP BY ALL""")
def enqueue_idempotent(t):
    """Payloads whose keys come in another order are the same work; done jobs don't stand in the way."""
    e = t["events"].select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("u"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("k"))
    old = e.where("id % 4 = 0").withColumn("payload_hash", jobs.payload_hash(F.col("kind"), F.format_string('{"u": %d, "k": %d}', "u", "k"))).withColumn("state", F.when(F.col("id") % 8 == 0, "queued").otherwise("done"))
    asked = e.where("id % 4 <> 0").withColumn("payload", F.format_string('{"k":%d,"u":%d}', "k", "u"))
    return jobs.enqueue(old, asked, [F.asc("id")]).select("kind", "u", "k", "id")


@query("""WITH f AS (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY ALL), p AS (SELECT source, doc_id // 100 AS page, count(*) FILTER (WHERE doc_id = first) AS new_items FROM documents JOIN f USING (source, lang) GROUP BY ALL),
g AS (SELECT *, min(new_items) OVER (PARTITION BY source ORDER BY page) AS m FROM (SELECT source, page, CAST(new_items AS BIGINT) AS new_items FROM p)) SELECT source, page, new_items FROM g WHERE m > 0""")
def pages_until_stale(t):
    d = t["documents"].select("source", F.floor(F.col("doc_id") / 100).alias("page"), "lang")
    return R.pages_until_stale(d.distinct(), "source", "page", "lang")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (VALUES ('F', '1-URGENT'), ('P', '5-LOW'))""")
def membership_pairs(t):
    a, b = F.array(F.lit("F"), F.lit("P")), F.array(F.lit("1-URGENT"), F.lit("5-LOW"))
    return R.membership(t["orders"], a, b, "o_orderstatus", "o_orderpriority").select("o_orderkey", "o_custkey")

