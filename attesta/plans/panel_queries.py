"""Queries of sources, panels, claims and small text rules, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, timefn
from ..operators import claims, dictionary as D, layout, panels, reports, scoring
from ..operators.scan import new_folder
from ..sources import readers
from . import pipelines
from .registry import Registry
from .text_queries import _W as WORDS, QUERIES as TEXT, _terms

QUERIES = Registry()
query = QUERIES.query


def bars(c):
    return F.array_join(c, "|")


def _folder(t, name):
    return new_folder(t.spark, name)


@query("""WITH o AS (SELECT o_custkey AS subject_id, o_orderpriority AS version, o_orderkey AS k, o_totalprice AS p, o_orderkey % 2 AS n FROM orders),
a AS (SELECT subject_id, version, arg_min(p, k) AS p, min(k) AS k, 0 AS n FROM o WHERE n = 0 GROUP BY ALL), u AS (SELECT * FROM a UNION ALL SELECT subject_id, version, p, k, n FROM o WHERE n = 1)
SELECT subject_id, version, arg_min(k, n * 10000000000 + k) AS match_id, arg_max(p, n * 10000000000 + k) AS score FROM u GROUP BY subject_id, version""")
def match_upserts(t):
    """Matches of new scores: one for each subject and version, the newest score under the first id."""
    o = t["orders"].select(F.col("o_orderkey").alias("match_id"), F.lit("r").alias("req_id"), F.col("o_custkey").alias("subject_id"), F.lit("v").alias("scorer_version"), F.col("o_orderpriority").alias("weights_version"), F.col("o_totalprice").alias("score"), F.timestamp_micros("o_orderkey").alias("scored_at"))
    old = scoring.upsert_matches(o.where("false"), o.where("match_id % 2 = 0")).join(o.groupBy("subject_id", "weights_version").agg(F.min_by("score", F.when(F.col("match_id") % 2 == 0, F.col("match_id"))).alias("first"), F.min(F.when(F.col("match_id") % 2 == 0, F.col("scored_at"))).alias("at")), ["subject_id", "weights_version"])
    old = old.withColumn("score", F.col("first")).withColumn("scored_at", F.col("at")).select(o.columns)
    return scoring.upsert_matches(old, o.where("match_id % 2 = 1")).select("subject_id", F.col("weights_version").alias("version"), "match_id", "score")


@query("""SELECT 'linkedin.com/in/u' || c_custkey AS ref_value, 'Ann ' || c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'Head, "Ops" at ' || c_mktsegment END AS headline FROM customer WHERE c_custkey % 10 > 0""")
def contact_export(t):
    """An export of contacts, written as CSV with a header and read as refs; rows without a profile go."""
    k = F.col("c_custkey")
    path, url = _folder(t, "contacts"), F.when(k % 10 > 0, F.concat(F.lit("https://www.linkedin.com/in/u"), k.cast("string"), F.lit("/?x=1"))).otherwise("https://www.linkedin.com/company/x")
    rows = t["customer"].select(F.lit("Ann").alias("First Name"), F.col("c_name").alias("Last Name"), url.alias("URL"), F.col("c_mktsegment").alias("Company"), F.when(k % 3 > 0, 'Head, "Ops"').alias("Position"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.contact_refs(readers.contacts(t.spark, path)).select("ref_value", "name", "headline")


@query("SELECT 'name ' || c_custkey AS value FROM customer WHERE c_custkey % 4 > 0")
def listed_lines(t):
    """A list of lines: white space goes, and blank lines."""
    path, k = _folder(t, "lines"), F.col("c_custkey")
    t["customer"].select(F.when(k % 4 > 0, F.concat(F.lit("  name "), k.cast("string"), F.lit("\t "))).otherwise("   ").alias("value")).write.text(path)
    return readers.line_list(t.spark, path)


@query("""SELECT 'linkedin.com/in/p' || (c_custkey % 400) AS ref_value, arg_min(c_name, c_custkey) AS name, 'Head of ' || arg_min(c_mktsegment, c_custkey) || ' - Firm' AS headline, min(c_custkey) AS position FROM customer WHERE c_custkey % 7 > 0 GROUP BY c_custkey % 400""")
def payload_refs(t):
    """People of search payloads: a result each, the first of each person kept."""
    k = F.col("c_custkey")
    link = F.when(k % 7 > 0, F.concat(F.lit("https://in.linkedin.com/in/P"), (k % 400).cast("string"), F.lit("/"))).otherwise("https://www.linkedin.com/jobs/view/1")
    result = F.struct(k.cast("int").alias("position"), F.concat("c_name", F.lit(" - Head of "), "c_mktsegment", F.lit(" – Firm | LinkedIn")).alias("title"), link.alias("link"), F.lit("s").alias("snippet"))
    payloads = t["customer"].select(F.to_json(F.struct(F.array(result).alias("organic_results"))).alias("payload"))
    return readers.search_refs(payloads, "payload").select("ref_value", "name", "headline", F.col("position").cast("long").alias("position"))


_REGIONS = [("A", "the"), ("A-B", "and"), ("C", "der"), ("C-D", "und"), ("E", "les")]
_REGION_SQL = f"""rw AS (SELECT doc_id, unnest({WORDS}) AS w, generate_subscripts({WORDS}, 1) AS i FROM documents), rl AS (SELECT doc_id, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM rw WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rg AS (SELECT doc_id, unnest([w, w || w2, w || w2 || w3]) AS win FROM rl), h AS (SELECT DISTINCT doc_id, code FROM rg JOIN (VALUES ('the', 'A'), ('and', 'A-B'), ('der', 'C'), ('und', 'C-D'), ('les', 'E')) r(place, code) ON regexp_replace(lower(win), '[^a-z0-9]', '', 'g') = place),
g AS (SELECT doc_id, string_agg(code, '|' ORDER BY -length(code), code) AS codes FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = a.doc_id AND b.code <> a.code AND starts_with(b.code, a.code)) GROUP BY doc_id)"""


def _places(t):
    return t.spark.createDataFrame(_REGIONS, "code string, place string")


@query(f"WITH {_REGION_SQL} SELECT * FROM g")
def regions_of_texts(t):
    """Regions that documents name, without those that another one covers."""
    return D.regions_in_text(t["documents"], "doc_id", "text", _places(t)).select("doc_id", bars("codes").alias("codes"))


@query(f"WITH n AS ({TEXT['ngram_dictionary_lookup'][1]}), {_REGION_SQL} SELECT d.doc_id AS jd_id, names AS skills, codes AS regions FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)")
def drafted_specs(t):
    """Skills and regions of job descriptions, by dictionaries."""
    return pipelines.draft(t["documents"].select(F.col("doc_id").alias("jd_id"), "text"), _terms(t), _places(t)).select("jd_id", bars("skills").alias("skills"), bars("regions").alias("regions"))


@query("""SELECT o_orderkey AS k, concat_ws('|', o_orderstatus, o_orderpriority) AS list, (o_orderkey % 30) || CASE o_orderkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'mo' ELSE ' weeks ago' END AS age,
  'Mar ' || (1990 + o_orderkey % 30) AS "from", CASE WHEN o_orderkey % 2 = 0 THEN 'Present' ELSE 'Mar ' || (1990 + o_orderkey % 30) END AS "to", (o_orderkey % 9) || ' yrs' AS duration,
  make_date(1990 + o_orderkey % 30, 3, 1) AS began, concat_ws('|', CASE WHEN o_orderkey % 2 = 0 THEN 'data' END, CASE WHEN o_orderkey % 5 = 0 THEN 'ops' END) AS routes, 'About me' || chr(10) || 'line ' || o_orderkey AS part FROM orders""")
def text_pieces(t):
    """Lists, ages, spans of time, months, routes and sections of made-up texts."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    year = (k % 30 + 1990).cast("string")
    span = F.concat(F.lit("Mar "), year, F.when(k % 2 == 0, " - Present").otherwise(""), F.lit(" · "), (k % 9).cast("string"), F.lit(" yrs"))
    age = F.concat(F.lit("Posted "), (k % 30).cast("string"), F.when(k % 3 == 0, "d • edited").when(k % 3 == 1, "mo").otherwise(" weeks ago"))
    routes = text.keyword_routes(F.concat(F.lit("Lead, "), F.when(k % 2 == 0, "Big Data").otherwise("database"), F.when(k % 5 == 0, "/site reliability").otherwise(" reliability")), {"data": ["data"], "ops": ["site reliability", "devops"]})
    cut = t["orders"].withColumn("page", F.concat(F.lit("Top\n  About me \nline "), s)).withColumn("t", text.time_split(span))
    return cut.select(
        k.alias("k"), bars(text.comma_list(F.concat(F.col("o_orderstatus"), F.lit(", , "), F.col("o_orderpriority"), F.lit(" ,")))).alias("list"), text.relative_age(age).alias("age"),
        "t.from", "t.to", "t.duration", timefn.parse_month(F.concat(F.lit("March. "), year)).alias("began"), bars(routes).alias("routes"), layout.section(cut, "page", "About me").alias("part"),
    )


@query("""SELECT s_suppkey AS company, concat_ws('|', CASE WHEN s_suppkey % 2 = 0 THEN 'founded=' || (1900 + s_suppkey % 100) END, 'industry=Trade ' || s_nationkey, 'size=' || s_suppkey || '-' || (s_suppkey + 9) || ' employees', CASE WHEN s_suppkey % 3 > 0 THEN 'website=https://s' || s_suppkey || '.example' END) AS fields FROM supplier""")
def company_overviews(t):
    """Lines of companies' overviews as fields, the first value of each."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    line = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    lines = F.array(
        line("Website", F.when(k % 3 > 0, F.concat(F.lit("https://s"), s, F.lit(".example")))), line("Company size", F.concat(s, F.lit("-"), (k + 9).cast("string"), F.lit(" employees"))),
        line(" Industry", F.concat(F.lit("Trade "), F.col("s_nationkey").cast("string"))), line("industry", F.lit("later")), line("x", F.when(k % 2 == 0, (k % 100 + 1900).cast("string")).otherwise("12345")),
    )
    rows = t["supplier"].select(k.alias("company"), F.posexplode(lines).alias("pos", "l")).select("company", "pos", "l.*").where("value IS NOT NULL")
    return panels.overview_fields(rows).select("company", bars(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("fields"))


@query("""SELECT event_id, k FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Photo link' WHEN 1 THEN 'date of birth' WHEN 2 THEN 'agency' ELSE event_type END AS k FROM events) WHERE k NOT IN ('Photo link', 'date of birth')""")
def readable_claims(t):
    """Claims without those whose key names a banned signal; words must be whole."""
    k = F.col("event_id") % 4
    rows = t["events"].select("event_id", F.when(k == 0, "Photo link").when(k == 1, "date of birth").when(k == 2, "agency").otherwise(F.col("event_type")).alias("claim_key"), F.lit("v").alias("claim_value"))
    return claims.without_banned(rows).select("event_id", F.col("claim_key").alias("k"))


@query("""SELECT user_id AS fetch_id, event_type AS version, min({'a': ts, 'b': props}).b AS error FROM events WHERE user_id % 5 > 0 GROUP BY ALL UNION ALL SELECT NULL, event_type, props FROM events WHERE user_id % 5 = 0""")
def quarantined(t):
    """One failure for each fetch and version, the earliest; those without a fetch all stay."""
    e = t["events"]
    rows = e.select(F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("fetch_id"), F.col("event_type").alias("extractor_version"), F.col("ts").alias("failed_at"), F.col("props").alias("error"))
    return claims.quarantine(rows).select("fetch_id", F.col("extractor_version").alias("version"), "error")


@query("""WITH c AS (SELECT c_custkey AS s, c_mktsegment AS seg, c_nationkey AS n, c_acctbal AS b FROM customer)
SELECT s, 'title' AS kind, NULL AS claim_key, 'Head of ' || seg AS claim_value, NULL::DOUBLE AS num FROM c WHERE s % 3 > 0 UNION ALL SELECT s, 'employer', NULL, 'Firm ' || n, NULL FROM c UNION ALL SELECT s, 'experience_years', NULL, NULL, (s % 20)::DOUBLE FROM c WHERE s % 4 > 0
UNION ALL SELECT s, 'education', NULL, 'School', NULL FROM c WHERE s % 5 = 0 UNION ALL SELECT s, 'location', 'R-' || n, 'City ' || n, NULL FROM c UNION ALL SELECT s, 'availability', NULL, 'open', NULL FROM c WHERE s % 7 = 0 UNION ALL SELECT s, 'link', NULL, 'u/' || s, NULL FROM c
UNION ALL SELECT s, 'skill', k, k, NULL FROM c, (VALUES ('SQL'), ('Go')) v(k) WHERE s % 2 = 0""")
def person_claim_rows(t):
    """Claims of profiles, read in one pass."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    people = t["customer"].select(
        k.alias("subject_id"), F.when(k % 3 > 0, F.concat(F.lit("Head of "), "c_mktsegment")).alias("title"), F.concat(F.lit("Firm "), n).alias("employer"), F.when(k % 4 > 0, k % 20).alias("years"),
        F.when(k % 2 == 0, text.strings(["SQL", "Go"])).alias("skills"), F.when(k % 5 == 0, "School").alias("education"), F.concat(F.lit("City "), n).alias("location"), F.concat(F.lit("R-"), n).alias("region"),
        F.when(k % 7 == 0, True).alias("open_to_work"), F.concat(F.lit("u/"), k.cast("string")).alias("url"),
    )
    rows = claims.person_claims(people, F.lit("2024-01-01").cast("timestamp"))
    return rows.select(F.col("subject_id").alias("s"), F.col("claim_type").alias("kind"), "claim_key", "claim_value", F.col("value_num").alias("num"))


@query("""SELECT o_custkey AS subject_id, arg_max(o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN -10000000000 ELSE epoch(o_orderdate) * 10000000 END + o_orderkey) AS employer FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1""")
def employers_now(t):
    """Each person's newest employer of their own saying; undated ones last."""
    k = F.col("o_orderkey")
    tier = F.when(F.col("o_orderstatus") == "O", "third_party_stated").otherwise("self_reported")
    rows = t["orders"].select(k.alias("claim_id"), F.col("o_custkey").alias("subject_id"), F.lit("employer").alias("claim_type"), F.col("o_orderpriority").alias("claim_value"), tier.alias("tier"), F.when(k % 5 > 0, F.col("o_orderdate")).alias("observed_at"))
    return panels.current_employer(rows)


@query("""SELECT c_custkey AS subject_id, c_custkey * 2 AS rank FROM customer WHERE c_custkey % 4 > 0 AND c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def corroboration_order(t):
    """Ranked people to corroborate: named, with an employer that identifies something, and not done."""
    k = F.col("c_custkey")
    people = t["customer"].select(k.alias("subject_id"), (k * 2).alias("rank"), F.when(k % 4 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(k % 3 == 0, "Kestrel Foods Ltd").when(k % 3 == 1, "Ltd Co").otherwise("Senior Engineer").alias("employer"))
    done = t["orders"].where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("subject_id"))
    return panels.corroboration_targets(people, done, ["ltd", "co"], ["engineer"]).select("subject_id", "rank")


@query("""WITH c AS (SELECT lpad(c_custkey::VARCHAR, 9, '0') AS ref_value, lower(c_mktsegment) AS seg FROM customer), r AS (SELECT ref_value, CASE WHEN seg = 'building' THEN 'a' WHEN seg IN ('machinery', 'household') THEN 'b' END AS req_id FROM c)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY ref_value) AS place FROM r WHERE req_id IS NOT NULL) WHERE place <= 5""")
def contacts_assigned(t):
    """Contacts by the words of their headline to requirements with room for five."""
    c = t["customer"].select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("ref_value"), F.concat(F.lit("Lead, "), "c_mktsegment").alias("headline"))
    return panels.assign_contacts(c, {"a": ["building"], "b": ["machinery", "household"]}, 5).select("ref_value", "req_id", F.col("place").cast("long").alias("place"))


@query("""WITH r AS (SELECT o_custkey % 20 AS req_id, o_orderkey % 1000 AS v, o_orderstatus AS st FROM orders WHERE o_orderpriority <> '1-URGENT'), d AS (SELECT DISTINCT o_orderkey % 1000 AS v FROM orders WHERE o_orderkey % 7 = 0), x AS (SELECT DISTINCT o_orderkey % 1000 AS v FROM orders WHERE o_orderkey % 11 = 0),
m AS (SELECT req_id, d.v IS NOT NULL AS done, x.v IS NOT NULL AS refused FROM r LEFT JOIN d ON d.v = r.v LEFT JOIN x ON x.v = r.v)
SELECT req_id, count(*) FILTER (WHERE NOT done AND NOT refused) AS todo, count(*) FILTER (WHERE done) AS done, count(*) FILTER (WHERE NOT done AND refused) AS refused, least(count(*) FILTER (WHERE NOT done AND NOT refused), 30) AS default_count FROM m GROUP BY req_id""")
def collection_panels(t):
    """For each requirement what is to read, done and refused, and how many to read by default."""
    o = t["orders"]
    v = (F.col("o_orderkey") % 1000).alias("ref_value")
    refs = o.select((F.col("o_custkey") % 20).alias("req_id"), v, F.when(F.col("o_orderpriority") != "1-URGENT", "passed").otherwise("rejected").alias("state"))
    return panels.collection_panel(refs, o.where("o_orderkey % 7 = 0").select(v), o.where("o_orderkey % 11 = 0").select(v), F.lit(30))


@query("""SELECT c_custkey AS k, true AS known FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_orderkey + 100000000, false FROM orders WHERE o_orderkey % 9 = 0""")
def named_rows(t):
    """Rows of the named keys, and the names that no row has."""
    rows = t["customer"].select(F.col("c_custkey").alias("k"))
    names = t["orders"].select(F.col("o_custkey").alias("k")).unionByName(t["orders"].where("o_orderkey % 9 = 0").select((F.col("o_orderkey") + 100_000_000).alias("k")))
    kept, missed = panels.named_only(rows, names, "k")
    return kept.select("k", F.lit(True).alias("known")).unionByName(missed.select("k", F.lit(False).alias("known")))


@query("""SELECT n_nationkey AS code, n_name AS label FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000)""")
def region_choice_labels(t):
    return panels.region_choices(t["customer"].where("c_acctbal > 5000").select(F.col("c_nationkey").alias("code")), t["nation"].select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label")))


@query("""WITH m AS (SELECT o_orderkey AS match_id, 'r' || (o_orderkey % 2) AS req_id, o_custkey AS s, o_orderdate AS at FROM orders), cur AS (SELECT DISTINCT req_id, s FROM m), act AS (SELECT * FROM m WHERE match_id % 5 = 0),
c AS (SELECT user_id AS s, count(*) FILTER (WHERE event_id % 2 = 0) AS proven, count(*) FILTER (WHERE event_id % 2 = 1) AS says FROM events GROUP BY 1),
p AS (SELECT cur.req_id, cur.s, least(count(*), 5) AS n, arg_max('do ' || act.match_id, epoch(act.at) * 10000000 + act.match_id) AS last FROM cur JOIN act ON act.s = cur.s AND act.req_id <> cur.req_id GROUP BY ALL)
SELECT cur.req_id, cur.s AS subject_id, coalesce(proven, 0)::INTEGER AS n_proven, coalesce(says, 0)::INTEGER AS n_says, coalesce(n, 0)::INTEGER AS n_prior, p.last AS last_prior FROM cur LEFT JOIN c ON c.s = cur.s LEFT JOIN p ON p.req_id = cur.req_id AND p.s = cur.s""")
def candidate_details(t):
    """Each current match with its person's proven and stated claims and the decisions on other requirements."""
    k = F.col("o_orderkey")
    matches = t["orders"].select(k.alias("match_id"), F.concat(F.lit("r"), (k % 2).cast("string")).alias("req_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("scored_at"))
    said = t["events"].select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("claim_type"), F.lit("k").alias("claim_key"), F.col("props").alias("claim_value"), F.when(F.col("event_id") % 2 == 0, "artifact_backed").otherwise("self_reported").alias("tier"), F.col("event_id").cast("string").alias("source_url"))
    actions = t["orders"].where("o_orderkey % 5 = 0").select(k.alias("match_id"), k.alias("action_id"), F.concat(F.lit("do "), k.cast("string")).alias("action"), F.col("o_orderdate").alias("acted_at"))
    asks = matches.select("req_id").distinct().withColumn("titles", text.strings(["Head"]))
    out = reports.detail(matches, said, actions, asks)
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).alias(f"n_{c}")
    return out.select("req_id", "subject_id", n("proven"), F.coalesce(F.when(F.col("says_so").isNotNull(), F.size("says_so")), F.lit(0)).alias("n_says"), n("prior"), F.get("prior", F.lit(0))["action"].alias("last_prior"))


@query("""SELECT o_orderkey AS k, NOT (o_orderkey % 3 = 0 AND o_orderkey % 4 = 0) AND NOT (o_orderkey % 5 = 0 AND o_orderkey % 2 = 0) AND NOT (o_orderkey % 7 > o_orderkey % 6 + 2) AS confirmed FROM orders""")
def confirmed_specs(t):
    """Which specs may go on: something to look for, a place where one is needed, years in order."""
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    spec = t["orders"].select(
        k.alias("k"), F.when(k % 3 == 0, none).otherwise(text.strings(["Head"])).alias("titles"), F.when(k % 4 == 0, none).otherwise(text.strings(["SQL"])).alias("must_have"),
        F.when(k % 5 == 0, none).otherwise(text.strings(["IN"])).alias("regions"), F.when(k % 2 == 0, "onsite").otherwise("remote").alias("remote"), (k % 7).alias("min_years"), (k % 6 + 2).alias("max_years"),
    )
    ok, blocked = pipelines.confirm(spec)
    return ok.select("k", F.lit(True).alias("confirmed")).unionByName(blocked.select("k", F.lit(False).alias("confirmed")))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'shortlisted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'Rejected' END AS action, o_orderkey % 4 < 2 AS known FROM orders""")
def recorded_actions(t):
    """Decisions that the report knows, and those that it refuses."""
    k = F.col("o_orderkey")
    good, bad = reports.valid_actions(t["orders"].select(k.alias("k"), F.when(k % 4 == 0, "shortlisted").when(k % 4 == 1, "rejected").when(k % 4 == 2, "Rejected").alias("action")))
    return good.withColumn("known", F.lit(True)).unionByName(bad.withColumn("known", F.lit(False)))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def backed_up(t):
    """A full copy of a table, read back."""
    path = _folder(t, "backup")
    readers.backup(t["supplier"].select("s_suppkey", "s_name", "s_nationkey"), path)
    return t.spark.read.parquet(path)
