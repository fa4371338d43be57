"""Queries of stores that grow by batches, of adapters, prefix joins and small rules, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims, dictionary, jobs, relational as R, store
from ..operators.scan import new_folder
from ..sources import adapters
from .registry import Registry

QUERIES = Registry()
query = QUERIES.query


@query("""
WITH e AS (SELECT user_id, nullif(event_type, 'view') AS k, event_id, value, props, event_id % 3 AS n FROM events)
SELECT user_id, k, arg_max(value, n * 10000000000 + event_id) AS value, arg_min(props, n * 10000000000 + event_id) AS props, arg_min(event_id, n * 10000000000 + event_id) AS event_id FROM e GROUP BY user_id, k""")
def bucketed_upserts(t):
    """A store made of a third of the events, then two batches merged into its buckets."""
    spark = t["events"].sparkSession
    e = t["events"].select("user_id", F.nullif(F.col("event_type"), F.lit("view")).alias("k"), "event_id", "value", "props")
    keys, path = ["user_id", "k"], new_folder(spark, "store")
    store.create(R.upsert(e.where("false"), e.where("event_id % 3 = 0"), keys, ["event_id"], ["value"]), path, keys, buckets=16)
    for n in (1, 2):
        store.merge(path, e.where(F.col("event_id") % 3 == n), keys, ["event_id"], ["value"], buckets=16)
    return store.stored(spark, path).select("user_id", "k", "value", "props", "event_id")


@query("SELECT c_nationkey AS nation, count(*) AS n, count(*) AS ids, bool_and(true) AS later FROM customer GROUP BY 1")
def appended_ids(t):
    """Customers appended in two batches: as many ids as rows, and those of the second batch are later."""
    spark, path = t["customer"].sparkSession, new_folder(t["customer"].sparkSession, "log")
    c = t["customer"].select("c_custkey", "c_nationkey")
    one = store.append(c.where("c_custkey % 2 = 0"), path, "fetch_id", block=512).agg(F.max("fetch_id")).first()[0]
    store.append(c.where("c_custkey % 2 = 1"), path, "fetch_id", block=512)
    later = F.bool_and((F.col("c_custkey") % 2 == 0) | (F.col("fetch_id") > F.lit(one)))
    return store.log(spark, path).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.count_distinct("fetch_id").alias("ids"), later.alias("later"))


@query("SELECT DISTINCT sha256(text) AS digest, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE text IS NOT NULL")
def kept_bodies(t):
    """Texts kept by their digest: a batch of half the documents, then one of all."""
    spark, path = t["documents"].sparkSession, new_folder(t["documents"].sparkSession, "bodies")
    docs = t["documents"].select("doc_id", F.col("text").alias("body"), F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))
    for batch in (docs.where("doc_id % 2 = 0"), docs):
        store.keep_bodies(batch.select("digest", "body"), path)
    return store.bodies(spark, path).select("digest", F.char_length("body").alias("chars"))


_CODES = "WITH a AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS x FROM customer), b AS (SELECT s_suppkey, CAST(s_suppkey * 3 AS VARCHAR) AS y FROM supplier)"


def _codes(t):
    return t["customer"].select("c_custkey", F.col("c_custkey").cast("string").alias("x")), t["supplier"].select("s_suppkey", (F.col("s_suppkey") * 3).cast("string").alias("y"))


@query(f"{_CODES} SELECT c_custkey, s_suppkey FROM a JOIN b ON starts_with(x, y) OR starts_with(y, x)")
def prefix_code_pairs(t):
    a, b = _codes(t)
    return dictionary.prefix_pairs(a, "x", b, "y").select("c_custkey", "s_suppkey")


@query(f"{_CODES} SELECT c_custkey, arg_max(y, length(y)) AS y FROM a LEFT JOIN b ON starts_with(x, y) GROUP BY c_custkey")
def longest_code(t):
    a, b = _codes(t)
    return dictionary.longest_prefix(a, "c_custkey", "x", b, "y")


@query("""SELECT c_custkey AS subject_id, 'u' || c_custkey AS login, 'r' || r || '/' || c_custkey AS repo, c_custkey % 7 AS size, c_nationkey AS go FROM customer, (VALUES (0), (1)) v(r) WHERE c_custkey % 5 <> r""")
def adapter_repos(t):
    """Repos of code-host payloads, written as files and read by their adapter."""
    path = new_folder(t["customer"].sparkSession, "payloads")
    k = F.col("c_custkey")
    repo = lambda i: F.struct(
        F.struct(F.concat(F.lit(f"r{i}/"), k.cast("string")).alias("full_name"), (k % 7).alias("size")).alias("repo"), F.create_map(F.lit("Go"), F.col("c_nationkey")).alias("languages")
    )
    repos = F.array_compact(F.array(*[F.when(k % 5 != i, repo(i)) for i in range(2)]))
    t["customer"].select(F.to_json(F.struct(k.alias("subject_id"), F.struct(F.concat(F.lit("u"), k.cast("string")).alias("login")).alias("user"), repos.alias("repos"))).alias("value")).write.text(path)
    return adapters.read(t["customer"].sparkSession, "code_host", path).select("subject_id", "login", "repo", "size", F.element_at("languages", "Go").alias("go"))


@query("""SELECT c_custkey AS req_id, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS passed, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS rejected, coalesce(any_value(n), 0) AS jobs, any_value(last) AS last_finished
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) FILTER (WHERE event_type = 'purchase') AS last FROM events GROUP BY 1) e ON user_id = c_custkey GROUP BY c_custkey""")
def ruled_out_counts(t):
    """Refs by gate and jobs of each role: customers are roles, orders refs, events jobs."""
    state = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "rejected").otherwise("new")
    refs = t["orders"].select(F.col("o_custkey").alias("req_id"), state.alias("gate_state"))
    done = t["events"].select(F.col("user_id").alias("req_id"), F.when(F.col("event_type") == "purchase", "done").otherwise("queued").alias("state"), F.col("ts").alias("finished_at"))
    return jobs.ruled_out(t["customer"].select(F.col("c_custkey").alias("req_id")), refs, done)


@query("""SELECT DISTINCT o_custkey AS subject_id, 'body/' || (l_partkey % 50) AS body_path FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 3 = 0 AND l_partkey % 7 > 0""")
def bodies_of_evidence(t):
    """The stored bodies that claims were read from: order lines are claims, parts fetches."""
    k = F.col("p_partkey")
    fetches = t["part"].select(k.alias("fetch_id"), F.when(k % 3 == 0, "profile").otherwise("web").alias("adapter"), F.when(k % 7 > 0, F.concat(F.lit("body/"), (k % 50).cast("string"))).alias("body_path"))
    lines = t["orders"].join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("subject_id"), F.col("l_partkey").alias("fetch_id"))
    return claims.evidence_bodies(lines, fetches, "profile")


@query("""WITH u AS (SELECT 0 AS f, l_orderkey AS k, l_partkey AS p, l_linenumber AS n, 'flag ' || l_returnflag AS v, NULL::VARCHAR AS note FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT 1, l_orderkey, l_partkey, l_linenumber, 'line ' || l_linestatus, 'second' FROM lineitem)
SELECT k, p, v, note FROM (SELECT *, row_number() OVER (PARTITION BY k, p ORDER BY f, n, v) AS rn FROM u) WHERE rn = 1""")
def parser_union(t):
    """What two parsers say of an order's parts, the first one's word before the second's."""
    base = t["lineitem"].select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"), "l_returnflag", "l_linestatus")
    one = base.where("n % 2 = 0").select("k", "p", "n", F.concat(F.lit("flag "), "l_returnflag").alias("v"))
    two = base.select("k", "p", "n", F.concat(F.lit("line "), "l_linestatus").alias("v"), F.lit("second").alias("note"))
    return R.union_by_precedence([one, two], ["k", "p"], [F.asc("n"), F.asc("v")]).select("k", "p", "v", "note")
