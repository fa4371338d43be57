"""The engine's operators on the driver's tables: sources, identities, plans, drafts, reports and the queue.

Each SQL twin is written from the rule that an operator follows, not from its plan.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text, timefn, urls
from ..operators import claims, dictionary as D, html, identity, jobs, layout, panels, relational as R, reports, scoring
from ..sources import readers
from . import pipelines
from .registry import Registry

QUERIES = Registry()
query = QUERIES.query

DAY = "2024-01-20 00:00:00"
_DAY = f"TIMESTAMP '{DAY}'"


def bars(c):
    return F.array_join(c, "|")


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def day():
    return F.lit(DAY).cast("timestamp_ntz")


TERMS = [("Alpha", "language", ["Brand#2"], ["Gamma"]), ("Beta", "language", ["Brand#3", "Brand#13"], []), ("Gamma", "tool", ["Brand#24"], [])]
_TERM = "CASE {0} WHEN 'Brand#2' THEN 'Alpha' WHEN 'Brand#3' THEN 'Beta' WHEN 'Brand#13' THEN 'Beta' WHEN 'Brand#24' THEN 'Gamma' END"


def terms(t):
    return readers.terms_frame(t.spark, TERMS)


def places(t):
    n = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.concat_ws("-", "r_name", "n_name").alias("code"), F.col("n_name").alias("place"), F.col("n_nationkey").alias("ord"))


# --- code host ------------------------------------------------------------------------------------------------------

_REPOS = """WITH r AS (SELECT o_custkey AS s, o_orderkey AS k, o_custkey % 10 > 0 AS person, o_orderkey % 13 = 0 AS private, o_orderkey % 5 = 0 AS archived, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 3 END AS stars,
  o_orderkey % 4 < 2 AS fork, o_orderkey % 6 AS size, o_orderkey % 8 <> 1 AS own, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS pushed FROM orders),
j AS (SELECT *, CASE WHEN private THEN 'private' WHEN archived AND coalesce(stars, 0) = 0 THEN 'archived with no stars' WHEN fork AND size = 0 THEN 'fork with no content' WHEN fork AND NOT own THEN 'fork owned by someone else'
  WHEN fork AND pushed IS NULL THEN 'fork with no commits by this user' ELSE '' END AS reason FROM r)
"""


def payloads(t):
    """Orders as code-host payloads, one repo each."""
    k = F.col("o_orderkey")
    login = F.concat(F.lit("User-"), F.col("o_custkey").cast("string"))
    repo = F.struct(
        F.lpad(k.cast("string"), 12, "0").alias("full_name"), (k % 4 < 2).alias("fork"), (k % 13 == 0).alias("private"), (k % 5 == 0).alias("archived"), (k % 6).alias("size"),
        F.when(k % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("pushed_at"), F.when(k % 9 > 0, k % 3).alias("stargazers_count"),
        F.struct(F.when(k % 8 == 1, "someone").otherwise(F.lower(login)).alias("login")).alias("owner"),
    )
    user = F.struct(login.alias("login"), F.when(F.col("o_custkey") % 10 > 0, "User").otherwise("Organization").alias("type"))
    return t["orders"].select(F.col("o_custkey").alias("subject_id"), F.to_json(F.struct(user.alias("user"), F.array(F.struct(repo.alias("repo"))).alias("repos"))).alias("payload"))


@query(_REPOS + "SELECT lpad(CAST(k AS VARCHAR), 12, '0') AS repo, reason = '' AS usable, reason FROM j")
def repo_reasons(t):
    return readers.code_host_repos(payloads(t), "payload").select("repo", claims.usable_repo().alias("r")).select("repo", "r.usable", "r.reason")


@query(_REPOS + "SELECT s, lpad(CAST(k AS VARCHAR), 12, '0') AS repo FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY pushed DESC NULLS LAST, k) AS n FROM j WHERE person) WHERE n <= 6 AND reason = ''")
def capped_repos(t):
    """From payloads to the repos that are read."""
    return claims.capped_repos(readers.code_host_repos(payloads(t), "payload"), 6).select(F.col("subject_id").alias("s"), "repo")


_SHARES = """WITH r AS (SELECT l_suppkey AS s, l_orderkey AS k, p_brand AS brand, CAST(sum(l_quantity) AS BIGINT) AS bytes, max(l_shipdate) AS shipped FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
h AS (SELECT *, bytes / sum(bytes) OVER (PARTITION BY s, k) AS share, max(shipped) OVER (PARTITION BY s, k) AS pushed FROM r),
c AS (SELECT *, {0} AS name FROM h WHERE share >= 0.1 AND brand <> 'Brand#24')
""".replace("{0}", _TERM.format("brand"))


def _by_language(t):
    r = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "l_orderkey", "p_brand").agg(F.sum("l_quantity").cast("long").alias("bytes"), F.max("l_shipdate").alias("at"))
    repos = r.groupBy(F.col("l_suppkey").alias("subject_id"), "l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "bytes"))).alias("languages"), F.max("at").alias("pushed_at"))
    return repos.select("subject_id", F.concat(F.lit("o/"), F.col("l_orderkey").cast("string")).alias("repo"), F.lit(None).cast("string").alias("url"), F.lit("me").alias("login"), "languages", "pushed_at")


@query(_SHARES + "SELECT s, name AS claim_key, CAST(bytes AS DOUBLE) AS value_num, 'https://github.com/me' AS source_url, name || ': ' || format('{:,}', bytes) || ' bytes (' || CAST(CAST(round_even(share * 100, 0) AS INTEGER) AS VARCHAR) || '% of o/' || k || '), last pushed ' || strftime(pushed, '%Y-%m-%d') AS snippet FROM c WHERE name IS NOT NULL")
def language_claims(t):
    """Canonical skills with a quotable snippet; unknown languages are proposals, not skills."""
    rows, _ = claims.language_claims(_by_language(t), terms(t), ["brand#24"])
    return rows.select(F.col("subject_id").alias("s"), "claim_key", "value_num", "source_url", "snippet")


@query(_SHARES + "SELECT s, 'o/' || k AS repo, brand AS raw FROM c WHERE name IS NULL")
def language_proposals(t):
    shares = claims.language_shares(_by_language(t), ["Brand#24"])
    known, _ = D.canonical(shares, "language", terms(t))
    return known.where("canonical IS NULL").select(F.col("subject_id").alias("s"), "repo", F.col("language").alias("raw"))


@query("""WITH a AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 6 = 0 THEN '  ' WHEN c_custkey % 7 = 0 THEN ' Atlantis' ELSE n_name END AS place, r_name || '-' || n_name AS code, c_custkey % 4 = 0 AS hireable FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 9 > 0)
SELECT s, 'location' AS claim_type, CASE WHEN trim(place) = 'Atlantis' THEN NULL ELSE code END AS claim_key, trim(place) AS claim_value, 'Location on GitHub profile: ' || trim(place) AS snippet FROM a WHERE trim(place) <> ''
UNION ALL SELECT s, 'availability', NULL, 'hireable', 'GitHub profile is marked as available for hire' FROM a WHERE hireable""")
def account_claims(t):
    """What people (customers by nation) state on a code host's page; organisations (each ninth) state nothing."""
    k = F.col("c_custkey")
    home = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.when(k % 6 == 0, "  ").when(k % 7 == 0, " Atlantis").otherwise(F.col("n_name"))
    accounts = home.select(k.alias("subject_id"), F.when(k % 9 > 0, "User").otherwise("Organization").alias("account_type"), place.alias("location"), (k % 4 == 0).alias("hireable"), F.lit("u").alias("url"))
    return claims.account_claims(accounts, places(t)).select(F.col("subject_id").alias("s"), "claim_type", "claim_key", "claim_value", "snippet")


@query("""SELECT p_partkey AS s, name AS claim_key, p_brand || ' — listed in the Skills section of the LinkedIn profile' AS snippet FROM (SELECT *, {0} AS name FROM part) WHERE name IS NOT NULL
UNION ALL SELECT p_partkey, 'Gamma', p_brand || ' — listed in the Skills section of the LinkedIn profile (Alpha is written in Gamma)' FROM part WHERE p_brand = 'Brand#2'""".replace("{0}", _TERM.format("p_brand")))
def implied_skills(t):
    """Listed skills under canonical names, and what they imply, said to be inferred."""
    people = t["part"].select(F.col("p_partkey").alias("subject_id"), F.lit("u").alias("url"), F.array("p_brand").alias("skills"))
    rows, _ = claims.listed_skills(people, terms(t))
    return rows.select(F.col("subject_id").alias("s"), "claim_key", "snippet")


@query("""WITH r AS (SELECT o_orderkey AS k, o_custkey % 8 AS req, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS hits, o_orderdate AS d FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 > 0 AND o_custkey % 9 > 0)
SELECT CAST(req AS VARCHAR) AS req_id, CAST(k AS VARCHAR) AS ref_value, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY req ORDER BY hits DESC, d, CAST(k AS VARCHAR)) AS n FROM r) WHERE n <= 6""")
def promising_refs(t):
    """What to read next within a budget of six: not those seen, nor people whose keys resolve already."""
    k = F.col("o_orderkey")
    raw = F.concat(F.when(k % 2 == 0, "knows GO ").otherwise("x "), F.when(k % 3 == 0, "and sql").otherwise(""))
    refs = t["orders"].select(F.col("o_custkey").alias("subject_id"), (F.col("o_custkey") % 8).cast("string").alias("req_id"), k.cast("string").alias("ref_value"), raw.alias("raw"), F.when(F.col("o_orderstatus") != "P", "passed").otherwise("failed").alias("state"), F.col("o_orderdate").alias("discovered_at"))
    reqs = refs.select("req_id").distinct().withColumn("must_have", text.strings(["Go", "SQL"]))
    seen = t["orders"].where("o_orderkey % 5 = 0").select(k.cast("string").alias("ref_value"))
    out = pipelines.promising(refs, reqs, seen, F.lit(6), 10, t["customer"].where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("subject_id")))
    return out.select("req_id", "ref_value", "rank")


# --- addresses and identities ---------------------------------------------------------------------------------------

_ADDRESS = {
    0: ("https://www.linkedin.com/in/Jane-{0}/", "linkedin.com/in/jane-{0}"), 1: ("in.linkedin.com/IN/Bob-{0}?trk=x", "linkedin.com/in/bob-{0}"), 2: ("https://linkedin.com/company/in/acme-{0}", None),
    3: ("https://linkedin.com/pub/Al-{0}/1/2a/3b", "linkedin.com/in/al-{0}"), 4: ("https://evil.com/in/x-{0}", None), 5: ("http://linkedin.com:80/e/in/Zed-{0}#a", "linkedin.com/in/zed-{0}"), 6: ("linkedin.com/in", None),
    7: ("https://linkedin.com/in/jobs", None), 8: ("https://notlinkedin.com/in/x-{0}", None),
}


def _address(key: str):
    k, out = F.col(key), None
    for n, (address, _) in _ADDRESS.items():
        shown = F.concat(*[x for part in address.split("{0}") for x in (F.lit(part), k.cast("string"))][:-1])
        out = F.when(k % 9 == n, shown) if out is None else out.when(k % 9 == n, shown)
    return out


_PROFILE = "CASE {0} % 9 " + " ".join("WHEN {n} THEN {x}".format(n=n, x="replace('" + v.replace("{0}", "@") + "', '@', CAST({0} AS VARCHAR))" if v else "NULL") for n, (_, v) in _ADDRESS.items()) + " END"


@query(f"SELECT c_custkey, {_PROFILE.replace('{0}', 'c_custkey')} AS ref_value FROM customer")
def profile_urls(t):
    """Addresses of people in the forms in which they turn up; other pages and hosts give none."""
    return t["customer"].select("c_custkey", urls.profile_url(_address("c_custkey")).alias("ref_value"))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'known' WHEN c_custkey % 2 = 0 AND c_custkey % 5 > 0 THEN 's' || c_custkey END AS subject_id
FROM (SELECT c_custkey, {_PROFILE.replace('{0}', 'c_custkey')} AS v FROM customer) WHERE v IS NOT NULL""")
def linked_refs(t):
    """Refs found by search take the subject whose slug they name; a known subject stays; other kinds aren't linked."""
    k = F.col("c_custkey")
    refs = t["customer"].select("c_custkey", F.when(k % 5 == 0, "other").otherwise("linkedin_url").alias("ref_kind"), urls.profile_url(_address("c_custkey")).alias("ref_value"), F.when(k % 4 == 0, "known").alias("subject_id")).where("ref_value IS NOT NULL")
    ids = t["customer"].select(k.alias("k"), urls.profile_url(_address("c_custkey")).alias("v")).where("k % 2 = 0 AND v IS NOT NULL").select(F.lit("linkedin_slug").alias("kind"), F.upper(F.split_part("v", F.lit("/"), F.lit(3))).alias("value"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("subject_id"))
    return identity.link_refs(refs, ids).select("c_custkey", "subject_id")


@query("""WITH i AS (SELECT DISTINCT n_regionkey AS v, n_nationkey % 3 AS s FROM nation), k AS (SELECT n_nationkey AS source, n_regionkey AS v FROM nation),
m AS (SELECT source, list_sort(list(DISTINCT CAST(s AS VARCHAR))) AS c FROM k JOIN i USING (v) GROUP BY source)
SELECT CAST(source AS VARCHAR) AS source_id, c[1] AS subject_a, c[2] AS subject_b, 'multiple candidates hold strong keys from the same source' AS reason, '{"all_matched":["' || array_to_string(c, '","') || '"]}' AS evidence FROM m WHERE len(c) > 1""")
def review_queue(t):
    """Sources whose keys name several subjects wait for a person."""
    n = t["nation"]
    keys = n.select(F.col("n_nationkey").cast("string").alias("source_id"), F.lit("email_sha256").alias("kind"), F.col("n_regionkey").cast("string").alias("value"))
    known = n.select(F.lit("email_sha256").alias("kind"), F.col("n_regionkey").cast("string").alias("value"), (F.col("n_nationkey") % 3).cast("string").alias("subject_id")).distinct()
    reviews = identity.propose(identity.resolve(keys, known))
    return identity.open_reviews(reviews).drop("status")


@query("""WITH c AS (SELECT c_custkey AS id, c_nationkey AS s, c_custkey % 41 AS k FROM customer), own AS (SELECT id, s, k, row_number() OVER (PARTITION BY s % 2, k ORDER BY CAST(s AS VARCHAR), id) AS n FROM c WHERE s < 8 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.s = 20 + c.s % 2 AND b.k = c.k))
SELECT c.id, CAST(CASE WHEN own.n = 1 THEN 20 + c.s % 2 ELSE c.s END AS VARCHAR) AS merged, CAST(c.s AS VARCHAR) AS restored FROM c LEFT JOIN own USING (id)""")
def merges_into_one(t):
    """Four subjects into each of two: of claims that collide there, one moves; unmerging restores all."""
    subject = F.col("c_nationkey").cast("string")
    rows = t["customer"].select(F.col("c_custkey").alias("claim_id"), subject.alias("subject_id"), F.lit("skill").alias("claim_type"), (F.col("c_custkey") % 41).cast("string").alias("claim_key"), F.lit("t").alias("source_url"))
    ids = t["customer"].select(F.col("c_custkey").alias("identity_id"), subject.alias("subject_id"), F.lit("cust").alias("kind"), F.col("c_custkey").cast("string").alias("value"))
    m = t["nation"].where("n_nationkey < 8").select(F.col("n_nationkey").cast("string").alias("from_id"), (F.lit(20) + F.col("n_nationkey") % 2).cast("string").alias("into_id"))
    i2, c2, journal = identity.merge(ids, rows, m)
    _, back = identity.unmerge(i2, c2, journal)
    return c2.select(F.col("claim_id").alias("id"), F.col("subject_id").alias("merged")).join(back.select(F.col("claim_id").alias("id"), F.col("subject_id").alias("restored")), "id")


@query("""SELECT c_nationkey AS s, string_agg(kind || '=' || v, '|' ORDER BY kind) AS keys FROM (SELECT c_nationkey, 'k' || (c_custkey % 3) AS kind, min(CAST(c_custkey AS VARCHAR)) AS v FROM customer GROUP BY ALL) GROUP BY 1""")
def strong_key_maps(t):
    ids = t["customer"].select(F.col("c_nationkey").alias("subject_id"), F.concat(F.lit("k"), (F.col("c_custkey") % 3).cast("string")).alias("kind"), F.col("c_custkey").cast("string").alias("value"))
    return identity.strong_key_map(ids).select(F.col("subject_id").alias("s"), bars(F.transform(F.map_entries("keys"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("keys"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Held' || c_custkey WHEN 1 THEN 'me-' || c_custkey WHEN 2 THEN 'blogger' END AS login, CASE c_custkey % 4 WHEN 0 THEN 'https://github.com/' || c_custkey WHEN 1 THEN 'https://huggingface.co/' || c_custkey WHEN 2 THEN 'https://' || c_custkey END AS link FROM customer""")
def logins_and_links(t):
    """A login of the first key that gives one, and the address of an identity's kind."""
    k = F.col("c_custkey")
    s = k.cast("string")
    none = F.lit(None).cast("string")
    keys = (
        F.when(k % 4 == 0, F.create_map(F.lit("github_login"), F.concat(F.lit("Held"), s), F.lit("url"), F.lit("https://github.com/other")))
        .when(k % 4 == 1, F.create_map(F.lit("github_url"), F.concat(F.lit("https://github.com/Me-"), s, F.lit("?tab=x"))))
        .when(k % 4 == 2, F.create_map(F.lit("url"), F.lit("https://github.com/orgs/x"), F.lit("blog"), F.lit("http://github.com/Blogger/repo")))
        .otherwise(F.create_map(F.lit("email"), F.lit("x")))
    )
    kind = F.when(k % 4 == 0, "github_login").when(k % 4 == 1, "hf_user").when(k % 4 == 2, "personal_domain").otherwise("so_user_id")
    return t["customer"].select("c_custkey", F.coalesce(urls.login_from_keys(keys), none).alias("login"), panels.link_url(kind, s).alias("link"))


@query("""SELECT page_id, regexp_replace(url, '[?#].*$', '') AS plain, regexp_replace(url, '[?#].*$', '') || CASE WHEN ends_with(regexp_replace(url, '[?#].*$', ''), '/') THEN '' ELSE '/' END AS slashed,
regexp_replace(url, '[?#].*$', '') || '|https://h.org/a/b' AS two FROM pages""")
def address_rules(t):
    plain = urls.without_query("url")
    items = F.array(F.col("url"), F.lit("/a/b?x=1"), F.concat("url", F.lit("#again")), F.lit("a/b"), F.lit("//c.org/d"))
    return t["pages"].select("page_id", plain.alias("plain"), urls.with_slash(plain).alias("slashed"), bars(urls.distinct_addresses(items, "https://h.org/", 2)).alias("two"))


# --- plans and drafts -----------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT r_regionkey AS k, '(' || string_agg(CASE WHEN contains(n_name, ' ') THEN '"' || n_name || '"' ELSE n_name END, ' OR ' ORDER BY n_nationkey) || ' OR India)' AS place FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1),
x AS (SELECT k, place || CASE WHEN k = 1 THEN ' fintech "two words"' ELSE '' END AS tail, CASE WHEN k % 2 = 0 THEN '(Engineer OR Developer OR Programmer OR SDE) ' ELSE '' END AS role FROM p)
SELECT k AS r_regionkey, 'site:linkedin.com/in/ ("Data Engineer" OR "Data Developer" OR "Data Programmer" OR "Data SDE") ' || tail || '|site:linkedin.com/in/ Analyst ' || tail || '|site:linkedin.com/in/ SQL ' || role || tail AS queries, 1 AS dropped FROM x""")
def query_plan_strings(t):
    """Title queries with all variants, skill queries with role words where artifacts are expected; the cap drops the last."""
    r = F.col("r_regionkey")
    extras = F.when(r == 1, text.strings(["fintech", "two words"])).otherwise(text.strings([]))
    reqs = t["region"].select(r.cast("string").alias("req_id"), text.strings(["Data Engineer", "", "Analyst", "Analyst"]).alias("titles"), text.strings(["SQL", "Power BI"]).alias("must_have"), F.array("r_name").alias("regions"), (r % 2 == 0).alias("expects"), extras.alias("extras"))
    cities = t["nation"].join(t["region"], F.col("n_regionkey") == r).select(F.col("r_name").alias("code"), F.col("n_name").alias("place"), F.col("n_nationkey").alias("ord"))
    return pipelines.query_plan(reqs, cities, cap=3).select(F.col("req_id").cast("int").alias("r_regionkey"), bars("queries").alias("queries"), "dropped")


@query("""WITH c AS (SELECT r_regionkey AS k, n_name, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 2)
SELECT r_regionkey, coalesce((SELECT string_agg('type:user' || l || ' location:"' || n_name || '"', '|' ORDER BY o, n_nationkey) FROM c, (VALUES (0, ' language:Go'), (1, ' language:SQL')) v(o, l) WHERE k = r_regionkey AND r_regionkey <> 3),
  (SELECT string_agg('type:user location:"' || n_name || '"', '|' ORDER BY n_nationkey) FROM c WHERE k = r_regionkey), 'type:user language:Go|type:user language:SQL') AS queries FROM region""")
def supplementary_plans(t):
    r = F.col("r_regionkey")
    reqs = t["region"].select(r.cast("string").alias("req_id"), F.when(r == 3, text.strings([])).otherwise(text.strings(["Go", "SQL"])).alias("must_have"), F.when(r == 2, text.strings([])).otherwise(F.array("r_name")).alias("regions"))
    cities = t["nation"].join(t["region"], F.col("n_regionkey") == r).select(F.col("r_name").alias("code"), F.col("n_name").alias("place"), F.col("n_nationkey").alias("ord"))
    return pipelines.supplementary_plan(reqs, cities).select(F.col("req_id").cast("int").alias("r_regionkey"), bars("queries").alias("queries"))


@query("""WITH p AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS n, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Firm ' || c_nationkey END AS e FROM customer)
SELECT s, 0 AS cost, '"' || n || '" "' || e || '"' AS query FROM p WHERE trim(n) <> '' AND e <> '' UNION ALL SELECT s, 1, '"' || n || '" "' || e || '" (team OR leadership OR "about us")' FROM p WHERE trim(n) <> '' AND e <> ''
UNION ALL SELECT s, CASE WHEN coalesce(e, '') = '' THEN 0 ELSE 2 END, '"' || n || '" (speaker OR panelist OR keynote OR conference)' FROM p WHERE trim(n) <> ''""")
def corroboration_plans(t):
    k = F.col("c_custkey")
    people = t["customer"].select(k.alias("subject_id"), F.when(k % 5 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(k % 3 == 1, "").when(k % 3 == 2, F.concat(F.lit(" Firm "), F.col("c_nationkey").cast("string"))).alias("employer"))
    return pipelines.corroboration_plan(people).select(F.col("subject_id").alias("s"), "cost", "query")


@query("""WITH l AS (SELECT page_id, page_id % 7 AS q, CASE WHEN page_id % 11 = 0 THEN '/relative' ELSE url END AS u FROM pages UNION ALL SELECT page_id + 1000000, page_id % 7, url FROM pages WHERE page_id % 3 = 0 AND page_id % 11 > 0),
h AS (SELECT *, regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1) AS host FROM l), w AS (SELECT *, CASE WHEN host = '' THEN 'no host' WHEN host LIKE '%.example.org' THEN 'example.org' END AS why FROM h),
f AS (SELECT q, u, min(page_id) AS pos FROM w WHERE why IS NULL GROUP BY ALL), k AS (SELECT q, string_agg(u, ' ' ORDER BY pos) FILTER (WHERE n <= 4) AS urls, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pos) AS n FROM f) GROUP BY q),
d AS (SELECT q, string_agg(n || ' from ' || why, '|' ORDER BY why) AS notes FROM (SELECT q, why, count(*) AS n FROM w WHERE why IS NOT NULL GROUP BY ALL) GROUP BY q)
SELECT a.q, coalesce(urls, '') AS urls, concat_ws('|', notes, CASE WHEN c > 4 THEN (c - 4) || ' past the per-query cap' END) AS notes FROM (SELECT DISTINCT q FROM l) a LEFT JOIN k USING (q) LEFT JOIN d USING (q)""")
def search_links(t):
    """Addresses that a search leads to, in order, and notes on what was dropped."""
    k = F.col("page_id")
    p = t["pages"].select(k, (k % 7).alias("q"), F.when(k % 11 == 0, "/relative").otherwise(F.col("url")).alias("u"))
    again = t["pages"].where("page_id % 3 = 0 AND page_id % 11 > 0").select((k + 1_000_000).alias("page_id"), (k % 7).alias("q"), F.col("url").alias("u"))
    out = pipelines.search_links(p.unionByName(again), "q", "page_id", "u", ["example.org"], cap=4)
    return out.select("q", F.array_join("urls", " ").alias("urls"), bars("notes").alias("notes"))


@query(f"""WITH j AS (SELECT p_partkey AS k, {_TERM.format('p_brand')} AS name, p_brand, p_size FROM part)
SELECT k AS jd_id, concat_ws('|', name, CASE WHEN name IS DISTINCT FROM 'Beta' THEN 'Beta' END) AS must_have, CASE WHEN name IS DISTINCT FROM 'Gamma' THEN 'Gamma' ELSE '' END AS nice_to_have, 'EUROPE-NATION_3' AS regions,
  CASE WHEN k % 3 = 0 THEN 'hybrid' ELSE 'onsite' END AS remote, CASE WHEN k % 2 = 0 THEN least(p_size % 9, 5) ELSE 1 END AS min_years, CASE WHEN k % 2 = 0 THEN greatest(p_size % 9, 5) ELSE 2 END AS max_years,
  concat_ws('|', CASE WHEN name IS NULL THEN p_brand END, 'zig') AS unmapped_skills, 'Atlantis' AS unmapped_places FROM j""")
def mapped_drafts(t):
    """Extracted names mapped to dictionaries, what is unknown listed, stated years before extracted ones."""
    k = F.col("p_partkey")
    said = F.when(k % 2 == 0, F.concat(F.lit("We ask for "), (F.col("p_size") % 9).cast("string"), F.lit(" to 5 years"))).otherwise("no years")
    jds = t["part"].select(
        k.alias("jd_id"), said.alias("text"), text.strings(["T"]).alias("titles"), F.array(F.col("p_brand"), F.lit("brand 13")).alias("must_have"), text.strings(["Brand#24", "beta", "zig", "zig"]).alias("nice_to_have"),
        text.strings(["Nation 3", "Atlantis"]).alias("places"), F.when(k % 3 == 0, "hybrid").otherwise("moon").alias("remote"), F.lit(1).alias("min_years"), F.lit(2).alias("max_years"),
    )
    out = pipelines.mapped_draft(jds, terms(t), places(t))
    return out.select("jd_id", *[bars(c).alias(c) for c in ("must_have", "nice_to_have", "regions", "unmapped_skills", "unmapped_places")], "remote", "min_years", "max_years")


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderkey % 9 AS m, o_orderkey % 2 AS t, o_orderkey % 5 AS r, CASE o_orderkey % 4 WHEN 0 THEN 'onsite' ELSE 'remote' END AS mode, o_orderkey % 7 AS lo, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 6 END AS hi FROM orders)
SELECT k, CASE WHEN m > 6 THEN m || ' must-have skills is a lot and usually returns nobody. Consider moving some to nice-to-have.' ELSE '' END AS warnings,
concat_ws('|', CASE WHEN t = 0 AND m = 0 THEN 'Add at least one job title or one must-have skill to search for.' END, CASE WHEN r = 0 AND mode = 'onsite' THEN 'This role is in-office but has no location. Add a location, or change it to fully remote.' END,
 CASE WHEN lo > hi THEN 'Minimum experience (' || lo || ') is above the maximum (' || hi || ').' END) AS blocking FROM s""")
def spec_reviews(t):
    k = F.col("o_orderkey")
    some = lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n), lambda x: x.cast("string"))).otherwise(text.strings([]))
    spec = t["orders"].select(k.alias("k"), some(k % 2).alias("titles"), some(k % 9).alias("must_have"), some(k % 5).alias("regions"), F.when(k % 4 == 0, "onsite").otherwise("remote").alias("remote"), (k % 7).cast("int").alias("min_years"), F.when(k % 3 > 0, k % 6).cast("int").alias("max_years"))
    return pipelines.review(spec).select("k", bars("warnings").alias("warnings"), bars("blocking").alias("blocking"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 1 THEN 'T' || o_custkey WHEN 2 THEN '' END AS titles, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 10 END AS min_years, CASE o_orderkey % 3 WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' END AS remote, CASE WHEN o_orderkey % 3 > 0 THEN 540 END AS max_staleness_days FROM orders""")
def stored_specs(t):
    """Typed specs of stored roles, with defaults; none where a role has none."""
    k = F.col("o_orderkey")
    js = F.when(k % 3 == 1, F.format_string('{"titles":["T%d"],"seniority":{"min_years":%d},"remote":"hybrid","unknown":1}', "o_custkey", k % 10)).when(k % 3 == 2, "{}")
    return pipelines.spec_of(t["orders"].select(k.alias("k"), js.alias("spec_json"))).select("k", bars("titles").alias("titles"), F.col("min_years").cast("long").alias("min_years"), "remote", "max_staleness_days")


@query("""SELECT p_partkey AS k, CASE WHEN p_brand = 'Brand#2' OR (p_brand IN ('Brand#3', 'Brand#13') AND p_size % 2 = 0) THEN 'engineering' ELSE 'business' END AS profile FROM part""")
def weight_profiles(t):
    """Alpha is code; Beta, an analyst's language, counts under a title with a role word only."""
    held, _ = D.canonical(t["part"], "p_brand", terms(t))
    title = F.when(F.col("p_size") % 2 == 0, "Data engineer").otherwise("Analyst")
    expects = D.expects_artifacts(F.array("canonical"), F.array(title), ["Alpha", "Beta"], ["Beta"])
    return held.select(F.col("p_partkey").alias("k"), scoring.profile_of(expects).alias("profile"))


_LOCAL = """WITH s AS (SELECT c_custkey AS s, c_name AS name, c_nationkey AS n, c_custkey % 6 > 0 AS active, c_custkey % 4 > 0 AS slug FROM customer), k AS (SELECT DISTINCT o_custkey AS s, o_orderpriority AS p FROM orders),
r AS (SELECT * FROM (VALUES ('a', ['1-URGENT', '5-LOW'], [1, 2, 3]), ('b', [], [4, 5]), ('c', ['2-HIGH'], []), ('d', [], [])) v(req, must, reg)),
h AS (SELECT req, s.* FROM r, s WHERE active AND slug AND (len(must) > 0 OR len(reg) > 0) AND (len(must) = 0 OR EXISTS (SELECT 1 FROM k WHERE k.s = s.s AND list_contains(must, p))) AND (len(reg) = 0 OR list_contains(reg, n)))
"""


@query(_LOCAL + "SELECT req AS req_id, s AS subject_id, 'linkedin.com/in/p' || s AS ref_value, name, 'title ' || s AS headline, CAST(n AS VARCHAR) AS location FROM (SELECT *, row_number() OVER (PARTITION BY req ORDER BY s) AS i FROM h) WHERE i <= 40")
def local_candidates(t):
    """Known people by must-haves and regions, where a requirement asks for them."""
    k = F.col("c_custkey")
    reqs = t.spark.createDataFrame([("a", ["1-URGENT", "5-LOW"], ["1", "2", "3"]), ("b", [], ["4", "5"]), ("c", ["2-HIGH"], []), ("d", [], [])], "req_id string, must_have array<string>, regions array<string>")
    subjects = t["customer"].select(k.alias("subject_id"), F.col("c_name").alias("name"), F.when(k % 6 > 0, "active").otherwise("archived").alias("status"), F.lit(None).cast("string").alias("place"), F.col("c_nationkey").cast("string").alias("region"))
    said = t["orders"].select(F.col("o_custkey").alias("subject_id"), F.lit("skill").alias("claim_type"), F.col("o_orderpriority").alias("claim_value"), F.col("o_orderdate").alias("observed_at"))
    titles = t["customer"].select(k.alias("subject_id"), F.lit("title").alias("claim_type"), F.concat(F.lit("title "), k.cast("string")).alias("claim_value"), F.lit(None).cast("timestamp_ntz").alias("observed_at"))
    ids = t["customer"].where("c_custkey % 4 > 0").select(k.alias("subject_id"), F.lit("linkedin_slug").alias("kind"), F.concat(F.lit("p"), k.cast("string")).alias("value"))
    return pipelines.local_candidates(reqs, subjects, said.unionByName(titles), ids, limit=40).select("req_id", "subject_id", "ref_value", "name", "headline", "location")


# --- reports --------------------------------------------------------------------------------------------------------


def _matches(t):
    """Orders as scores of customers: the requirement is the nation."""
    c = t["customer"].select("c_custkey", F.col("c_nationkey").cast("string").alias("req_id"))
    o = t["orders"].join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("match_id"), "req_id", F.col("o_custkey").alias("subject_id"), (F.col("o_totalprice") / 500000).alias("score"), (F.col("o_orderstatus") != "P").alias("passed"), F.col("o_orderdate").alias("scored_at"))


def _actions(t):
    name = F.when(F.col("o_orderstatus") == "F", "shortlisted").when(F.col("o_orderstatus") == "O", "rejected").otherwise("contacted")
    return t["orders"].where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("action_id"), F.col("o_orderkey").alias("match_id"), name.alias("action"), F.col("o_orderdate").alias("acted_at"))


@query("""WITH m AS (SELECT o_orderkey, c_nationkey, o_custkey, o_orderstatus, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CAST(n_nationkey AS VARCHAR) AS req_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS found, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS kept,
(SELECT count(DISTINCT o_custkey) FROM m WHERE c_nationkey = n_nationkey) AS ranked, (SELECT count(*) FROM m WHERE c_nationkey = n_nationkey AND o_orderkey % 3 = 0 AND o_orderstatus = 'F') AS shortlisted,
(SELECT strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = n_nationkey) AS last_run FROM nation""")
def overview(t):
    reqs = t["nation"].select(F.col("n_nationkey").cast("string").alias("req_id"))
    refs = t["customer"].select(F.col("c_nationkey").cast("string").alias("req_id"), F.when(F.col("c_acctbal") > 0, "passed").otherwise("failed").alias("state"))
    runs = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").cast("string").alias("req_id"), F.col("l_shipdate").alias("run_at"))
    return reports.overview(reqs, refs, _matches(t), _actions(t), runs).select("req_id", "found", "kept", "ranked", "shortlisted", stamp("last_run"))


@query(f"""WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' ELSE 'done' END AS state FROM events), j AS (SELECT user_id, count(*) AS pending, count(*) FILTER (WHERE state = 'queued' AND event_id % 2 = 0 AND ts < {_DAY} - INTERVAL 90 SECOND) AS stalled,
 coalesce(min(kind) FILTER (WHERE state = 'running'), min(kind)) AS stage, CAST(floor(epoch({_DAY}) - epoch(min(ts))) AS BIGINT) AS age_s FROM (SELECT *, ['collect', 'discover', 'enrich', 'score'][event_id % 4 + 1] AS kind FROM e) WHERE state <> 'done' GROUP BY user_id),
m AS (SELECT c_nationkey AS n, count(DISTINCT c_custkey) AS ranked FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 GROUP BY 1)
SELECT CAST(n_nationkey AS VARCHAR) AS req_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS found, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS kept, coalesce(ranked, 0) AS ranked, coalesce(pending, 0) AS pending, coalesce(stalled, 0) AS stalled,
 CASE stage WHEN 'discover' THEN 'Searching LinkedIn' WHEN 'enrich' THEN 'Reading profiles' WHEN 'score' THEN 'Ranking' ELSE 'Starting up' END AS doing, coalesce(age_s, 0) AS age_s FROM nation LEFT JOIN m ON n = n_nationkey LEFT JOIN j ON user_id = n_nationkey""")
def role_progress(t):
    e = F.col("event_type")
    reqs = t["nation"].select(F.col("n_nationkey").cast("string").alias("req_id"))
    refs = t["customer"].select(F.col("c_nationkey").cast("string").alias("req_id"), F.when(F.col("c_acctbal") > 0, "passed").otherwise("failed").alias("state"))
    read = t["customer"].where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("subject_id"))
    queue = t["events"].select(
        F.when(e == "view", "running").when(e == "click", "queued").otherwise("done").alias("state"), (F.col("event_id") % 2).alias("attempts"), F.element_at(text.strings(["collect", "discover", "enrich", "score"]), (F.col("event_id") % 4 + 1).cast("int")).alias("kind"),
        F.col("ts").alias("created_at"), F.format_string('{"role_id":"%d"}', "user_id").alias("payload"),
    )
    return reports.role_progress(reqs, refs, _matches(t), read, queue, day()).select("req_id", "found", "kept", "ranked", "pending", "stalled", "doing", "age_s")


@query("""WITH m AS (SELECT o_orderkey AS id, c_nationkey AS r, o_custkey AS s, o_totalprice / 500000 AS score, o_orderstatus <> 'P' AS passed, o_orderdate AS ts, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, s ORDER BY ts DESC, id DESC) AS n FROM m) WHERE n = 1),
act AS (SELECT r, s, CASE arg_max(st, (ts, id)) WHEN 'F' THEN 'shortlisted' WHEN 'O' THEN 'rejected' ELSE 'contacted' END AS last_action FROM m WHERE id % 3 = 0 GROUP BY ALL),
k AS (SELECT o_custkey AS s, p_brand AS b, o_orderstatus = 'F' AS proven, l_extendedprice AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
pr AS (SELECT s, string_agg(b, '|' ORDER BY v DESC, b) AS top FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY v DESC, b) AS n FROM (SELECT s, b, round(sum(v), 2) AS v FROM k WHERE proven GROUP BY ALL)) WHERE n <= 3 GROUP BY s),
sd AS (SELECT s, string_agg(b, '|' ORDER BY b) AS top FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY b) AS n FROM (SELECT DISTINCT s, b FROM k WHERE NOT proven)) WHERE n <= 3 GROUP BY s)
SELECT CAST(r AS VARCHAR) AS req_id, s AS subject_id, c_name AS name, round(score, 8) AS score, last_action, coalesce(pr.top, sd.top) AS top_skills, CASE WHEN score >= 0.55 THEN 'Strong match' WHEN score >= 0.4 THEN 'Good match' WHEN score >= 0.25 THEN 'Possible match' ELSE 'Weak' END AS label,
 CASE WHEN s % 4 = 1 THEN 'unchecked' WHEN passed THEN 'ranked' ELSE 'ruled_out' END AS bucket FROM cur JOIN customer ON s = c_custkey LEFT JOIN act USING (r, s) LEFT JOIN pr USING (s) LEFT JOIN sd USING (s) WHERE s % 5 > 0""")
def shortlist(t):
    """Current matches of active people with their last decision, strongest skills and bucket."""
    k = F.col("c_custkey")
    subjects = t["customer"].select(k.alias("subject_id"), F.col("c_name").alias("name"), F.when(k % 5 > 0, "active").otherwise("archived").alias("status"))
    lines = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    held = lines.select(F.col("o_custkey").alias("subject_id"), F.lit("skill").alias("claim_type"), F.col("p_brand").alias("claim_key"), F.col("l_extendedprice").alias("value_num"), F.when(F.col("o_orderstatus") == "F", "artifact_backed").otherwise("self_reported").alias("tier"))
    read = t["customer"].where("c_custkey % 4 <> 1").select(k.alias("subject_id"))
    out = reports.shortlist(_matches(t), subjects, _actions(t), held, read)
    return out.select("req_id", "subject_id", "name", F.round("score", 8).alias("score"), "last_action", bars("top_skills").alias("top_skills"), "label", "bucket")


@query("""WITH m AS (SELECT o_orderkey AS id, c_nationkey AS r, o_custkey AS s, o_orderdate AS at, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS req_id, count(*) AS n FROM customer WHERE c_acctbal <= 0 AND NOT EXISTS (SELECT 1 FROM m WHERE s = c_custkey AND st = 'P') GROUP BY 1""")
def not_opened(t):
    """Failed refs whose person was never read, by requirement."""
    refs = t["customer"].select(F.col("c_nationkey").cast("string").alias("req_id"), F.col("c_custkey").alias("subject_id"), F.when(F.col("c_acctbal") > 0, "passed").otherwise("failed").alias("state"))
    read = t["orders"].where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("subject_id"))
    return reports.not_opened(refs, read).groupBy("req_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, max(CASE WHEN event_id % 3 = 0 THEN 1 ELSE CAST(json_extract(props, '$.k') AS INTEGER) END) AS depth FROM events GROUP BY 1")
def search_depths(t):
    payload = F.when(F.col("event_id") % 3 == 0, "{}").otherwise(F.replace("props", F.lit('"k"'), F.lit('"pages"')))
    return reports.search_depth(t["events"].select("user_id", payload.alias("payload")), "user_id", "payload")


@query("""WITH m AS (SELECT o_orderkey AS id, c_nationkey AS r, o_custkey AS s, o_totalprice AS v, o_orderdate AS at FROM orders JOIN customer ON o_custkey = c_custkey), cur AS (SELECT r, s FROM m GROUP BY ALL)
SELECT CAST(n_nationkey AS VARCHAR) AS req_id FROM nation WHERE NOT EXISTS (SELECT 1 FROM cur WHERE r = n_nationkey AND s % 40 = 0)""")
def degraded(t):
    reqs = t["nation"].select(F.col("n_nationkey").cast("string").alias("req_id"))
    known = t["customer"].where("c_custkey % 40 = 0").select(F.col("c_custkey").alias("subject_id"), F.lit("experience_years").alias("claim_type"))
    return reports.degraded(reqs, _matches(t), known)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'skill_match=0.5' ELSE 'availability=1.0|skill_match=0.5' END AS shown, 'a=1|b=3|c=4' AS merged FROM orders""")
def map_rules(t):
    """Components that a version gives no weight go; of two maps the second wins."""
    k = F.col("o_orderkey")
    parts = F.create_map(F.lit("availability"), F.lit(1.0), F.lit("skill_match"), F.lit(0.5))
    weights = F.when(k % 3 == 0, F.create_map(F.lit("availability"), F.lit(0.0))).when(k % 3 == 1, F.create_map(F.lit("skill_match"), F.lit(0.4)))
    show = lambda m: bars(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    both = R.merged_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3), F.lit("c"), F.lit(4)))
    return t["orders"].select(k.alias("id"), show(reports.weighted_components(parts, weights)).alias("shown"), show(both).alias("merged"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000 AND c_nationkey IN (1, 2, 3, 4, 5, 6)")
def conjunctive_filter(t):
    """The conditions that a caller asked for; those left out don't count."""
    asked = {"segment": "BUILDING", "least": 1000, "nations": [1, 2, 3, 4, 5, 6], "name": None}
    c = [F.col("c_mktsegment") == asked["segment"], F.col("c_acctbal") > asked["least"], F.col("c_nationkey").isin(asked["nations"]), F.col("c_name") == asked["name"] if asked["name"] else None]
    return t["customer"].where(R.all_of(c)).select("c_custkey")


@query("SELECT lang AS key, count(*) AS n FROM documents WHERE n_chars > 500 GROUP BY 1")
def dropped_by_key(t):
    return R.dropped_counts(t["documents"].where("n_chars > 500").withColumnRenamed("lang", "key"), "key")


@query("""SELECT field, CAST(present AS BIGINT) AS present, n FROM (SELECT count(*) AS n, count(nullif(c_mktsegment, 'BUILDING')) AS segment, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS balance FROM customer) UNPIVOT (present FOR field IN (segment, balance))""")
def field_presence(t):
    refs = t["customer"].select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    return readers.field_presence(refs, ["segment", "balance"])


@query("""SELECT DISTINCT l_suppkey AS doc, l_partkey AS claim_value FROM lineitem a WHERE l_suppkey % 3 > 0 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_suppkey = a.l_suppkey AND b.l_partkey = a.l_partkey AND b.l_quantity > 30) AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_suppkey = a.l_suppkey AND b.l_quantity > 30)""")
def stale_values(t):
    """Stored values that the newest parse of a document lacks; documents that it didn't read are left alone."""
    rows = t["lineitem"].select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("claim_value"), "l_quantity")
    stored = rows.where("doc % 3 > 0").select("doc", "claim_value").distinct()
    return claims.stale_claims(stored, rows.where("l_quantity > 30").select("doc", "claim_value"), "doc")


# --- the queue ------------------------------------------------------------------------------------------------------

_STATE = "CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'done' END"


def _jobs(t):
    e = F.col("event_type")
    return t["events"].select(
        F.col("event_id").alias("id"), F.when(e == "click", "running").when(e == "view", "queued").otherwise("done").alias("state"), e.alias("kind"), (F.col("event_id") % 5).cast("int").alias("attempts"), F.col("ts").alias("created_at"), F.lit(None).cast("string").alias("last_error")
    )


@query(f"""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'done' WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 5 >= 3 THEN 'failed' ELSE 'queued' END ELSE {_STATE} END AS state, CASE WHEN event_id % 3 = 1 THEN 'boom' END AS last_error FROM events""")
def finished_jobs(t):
    out = t["events"].where("event_id % 3 < 2").select(F.col("event_id").alias("id"), (F.col("event_id") % 3 == 0).alias("ok"), F.when(F.col("event_id") % 3 == 1, "boom").alias("error"))
    return jobs.finish(_jobs(t), out).select("id", "state", "last_error")


@query(f"""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 AND {_STATE} <> 'done' THEN 'stopped' ELSE {_STATE} END AS state, CASE WHEN event_id % 4 = 0 AND {_STATE} <> 'done' THEN 'stopped' END AS last_error FROM events""")
def stopped_jobs(t):
    return jobs.stop(_jobs(t), t["events"].where("event_id % 4 = 0").select(F.col("event_id").alias("id"))).select("id", "state", "last_error")


@query("SELECT event_id AS id FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 20")
def claimed_jobs(t):
    """The twenty oldest queued jobs."""
    return jobs.next_jobs(_jobs(t), 20).select("id")


@query(f"SELECT {_STATE} AS state, count(*) AS n FROM events GROUP BY 1")
def job_states(t):
    return jobs.state_counts(_jobs(t))


@query("SELECT kind, kind IN ('click', 'view') AND EXISTS (SELECT 1 FROM events WHERE event_type = kind) AS pending FROM (VALUES ('click'), ('view'), ('purchase'), ('none')) k(kind)")
def pending_kinds(t):
    kinds = t.spark.createDataFrame([("click",), ("view",), ("purchase",), ("none",)], "kind string")
    return jobs.pending(_jobs(t), kinds)


@query("""SELECT user_id AS id, left(repeat(CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) || '-', 200), 500) AS note FROM events GROUP BY 1""")
def progress_notes(t):
    """The newest note of each job, cut to 500 characters."""
    notes = t["events"].select(F.col("user_id").alias("id"), F.repeat(F.concat(F.col("event_id").cast("string"), F.lit("-")), 200).alias("note"), F.col("ts").alias("noted_at"))
    return jobs.noted(t["events"].select(F.col("user_id").alias("id")).distinct(), notes)


@query("""WITH p AS (SELECT DISTINCT c_nationkey AS r, o_orderpriority AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 50 = 0)
SELECT DISTINCT CAST(a.r AS VARCHAR) AS read_for, CAST(b.r AS VARCHAR) AS req_id FROM p a JOIN p b ON a.s = b.s AND a.r <> b.r WHERE a.r < 3""")
def other_requirements(t):
    """Requirements whose rankings change as they share people with one that was read."""
    refs = t["orders"].where("o_orderkey % 50 = 0").join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("string").alias("req_id"), F.col("o_orderpriority").alias("subject_id")).distinct()
    return jobs.also_affected(refs, refs.where("CAST(req_id AS INT) < 3"))


@query(f"""WITH f AS (SELECT user_id AS h, event_id, ts FROM events WHERE value > 20 AND ts > {_DAY} - INTERVAL 240 HOUR) SELECT h AS url_hash, event_id AS fetch_id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY ts DESC, event_id DESC) AS n FROM f) WHERE n = 1""")
def cached_fetches(t):
    f = t["events"].select(F.col("user_id").alias("url_hash"), F.col("event_id").alias("fetch_id"), F.lit("p").alias("body_path"), F.col("ts").alias("fetched_at"), F.when(F.col("value") > 20, 200).otherwise(404).alias("status"))
    return jobs.cached(f, day(), 240).select("url_hash", "fetch_id")


@query(f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'no policy for this source' WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 8 = 1 THEN 'robots' ELSE 'disabled' END END AS blocked, greatest(0, 50 - CAST(floor(value) AS BIGINT)) AS budget,
CASE WHEN value >= 50 THEN 'retry' WHEN value >= 30 THEN CASE WHEN event_type = 'error' THEN 'retry' ELSE 'fail' END ELSE 'ok' END AS outcome, CASE event_type WHEN 'error' THEN 'killed' END AS reason, ts > {_DAY} AS live, (event_id % 7) + (9 - event_id % 7) * (event_id % 3 + 1) AS cost,
CASE WHEN event_id % 5 = 0 THEN 'busy' WHEN event_id % 5 = 1 THEN 'none left' END AS refusal, CASE WHEN event_id % 5 > 1 THEN greatest(0, least(event_id % 11, 6)) END AS allowed FROM events""")
def queue_rules(t):
    """Refusals of a policy, budgets, outcomes, kill switch, live sessions, cost and preflight, event by event."""
    k, v, e = F.col("event_id"), F.col("value"), F.col("event_type")
    status = F.when(v >= 50, 503).when(v >= 30, 404).otherwise(200)
    pre = reports.preflight([(k % 5 == 0, "busy"), (k % 5 == 1, "none left")], k % 11, F.lit(6).cast("long"))
    p = jobs.kill(t["events"].select("*", e.alias("domain"), F.lit(None).cast("string").alias("reason"), F.lit(True).alias("enabled")), "error", "killed")
    live = jobs.live_sessions(t["events"].select("event_id", F.col("ts").alias("expires_at")), day()).select("event_id", F.lit(True).alias("live"))
    out = p.select(
        "event_id", jobs.policy_reason(k % 4 != 0, k % 4 != 1, F.when(k % 8 == 1, "robots")).alias("blocked"), jobs.budget(F.lit(50).cast("long"), F.floor(v)).alias("budget"), jobs.outcome(status, e, ["error"]).alias("outcome"), "reason",
        reports.search_cost(F.lit(9), k % 7, k % 3).alias("cost"), pre["refusal"].alias("refusal"), pre["count"].alias("allowed"),
    )
    return out.join(live, "event_id", "left").withColumn("live", F.coalesce("live", F.lit(False)))


@query("""WITH n AS (SELECT user_id AS u, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT a.event_id, CAST(max(b.t + (a.n - b.n) * 7200000000) // 1000000 AS BIGINT) AS starts_s FROM n a JOIN n b ON a.u = b.u AND b.n <= a.n GROUP BY a.event_id""")
def throttled_fetches(t):
    """Fetches of a domain two hours apart at least."""
    out = R.throttled(t["events"].select("event_id", "user_id", "ts"), ["user_id"], "ts", 7200, "event_id")
    return out.select("event_id", F.unix_seconds("starts_at").alias("starts_s"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'off' WHEN event_id % 7 = 0 THEN 'spent' WHEN event_id % 5 = 0 THEN 'no-browser' WHEN event_id % 3 = 0 THEN 'busy' WHEN event_id % 4 <> 1 AND event_id % 6 = 0 THEN 'nobody' END AS refusal,
CASE WHEN event_id % 11 > 0 AND event_id % 7 > 0 AND event_id % 5 > 0 AND event_id % 3 > 0 AND NOT (event_id % 4 <> 1 AND event_id % 6 = 0) THEN CASE WHEN event_id % 4 = 1 THEN least(3, event_id % 7) ELSE greatest(1, least(event_id % 9, event_id % 6, event_id % 7)) END END AS n FROM events""")
def reading_requests(t):
    k = F.col("event_id")
    r = reports.reading(k % 11 == 0, k % 7, k % 5 != 0, k % 3 == 0, k % 6, k % 9, F.when(k % 4 == 1, 3).otherwise(0).cast("long"))
    return t["events"].select("event_id", r.alias("r")).select("event_id", "r.refusal", F.col("r.count").alias("n"))


# --- expressions ----------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'No public sign of Go' WHEN 1 THEN 'Pune is Located outside Goa' WHEN 2 THEN 'Most recent public work is 9 days old' WHEN 3 THEN 'No reason recorded' ELSE 'Plain' END AS reason,
CASE o_orderkey % 3 WHEN 0 THEN 'Dev at Acme' WHEN 1 THEN 'Dev' ELSE 'a headline' END AS headline, o_orderkey % 4 < 2 AS junior, o_orderkey % 2 = 0 AS title, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'naviq|data' END AS employer_words,
CASE o_orderkey % 2 WHEN 0 THEN o_orderkey % 90 END AS version, 'body ' || o_orderkey AS body, CASE o_orderkey % 3 WHEN 0 THEN 'jobs' WHEN 1 THEN 'about' END AS tab, o_orderkey * 1000 AS reactions, 0 AS comments, CASE WHEN o_orderkey = 7 THEN '7' ELSE CAST(o_orderkey AS VARCHAR) || '|7' END AS ids,
o_orderkey % 2 = 1 AS present FROM orders""")
def text_rules(t):
    """Reasons, headlines, juniors, titles, employers, header versions, tabs, counts, ids and presence, order by order."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    pick = lambda n, *x: F.element_at(F.array(*[F.lit(v).cast("string") if v is None or isinstance(v, str) else v for v in x]), (k % n + 1).cast("int"))
    head = text.header_version(F.when(k % 2 == 0, F.concat(F.lit("# version: "), (k % 90).cast("string"), F.lit("\nbody "), s)).otherwise(F.concat(F.lit("body "), s)))
    post = panels.post_counts(F.concat(F.format_number(k * 1000, 0), F.lit(" reactions")), F.lit(None).cast("string"))
    names = pick(2, "Senior Data Engineer", "Naviq Data Ltd")
    return t["orders"].select(
        k.alias("k"), text.plain_reason(pick(5, "must: no evidence for Go", "location: Pune is outside Goa", "activity: most recent public work 9 days old", "x: ", "plain")).alias("reason"),
        text.display_headline(pick(3, "Dev", "Dev", ""), pick(3, "Acme", None, "Acme"), F.lit("a headline")).alias("headline"), text.is_junior(pick(4, "Data Intern", "Jr. dev", "Senior dev", "Lead")).alias("junior"),
        text.looks_like_title(names, ["engineer"]).alias("title"), bars(text.employer_keys(names, ["ltd"], ["engineer"])).alias("employer_words"), head["version"].cast("long").alias("version"), head["body"].alias("body"),
        text.classify(pick(3, "All JOBS here", "About us", "other"), [("jobs", "jobs"), ("about", "about")]).alias("tab"), post["reactions"].alias("reactions"), post["comments"].cast("int").alias("comments"),
        bars(text.activity_ids(F.concat(F.lit("urn:li:activity:"), s, F.lit(" urn:li:activity:7 urn:li:activity:"), s))).alias("ids"), text.present_in(pick(2, " ", "BODY "), F.concat(F.lit("a body "), s)).alias("present"),
    )


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 5 THEN 7 END AS min_years, NULL::INTEGER AS max_years FROM orders""")
def years_minimum(t):
    """Stated minima only: "at least 3 languages" states no years."""
    k = F.col("o_orderkey")
    said = F.element_at(text.strings(["At least 3 years", "minimum of 4 years", "min. 4 years", "at least 3 languages", "years 5", "7+ years"]), (k % 6 + 1).cast("int"))
    return t["orders"].select(k.alias("k"), text.years_from_text(said).alias("y")).select("k", "y.min_years", "y.max_years")


@query(f"""SELECT event_id, CAST(floor(epoch({_DAY}) - epoch(ts)) AS BIGINT) AS age_s, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed, strftime(CASE WHEN event_id % 3 = 0 THEN ts WHEN event_id % 3 = 1 THEN {_DAY} END, '%Y-%m-%d %H:%M:%S') AS seen,
CASE WHEN floor(date_diff('day', CAST(ts AS DATE), DATE '2030-01-01') / 365.25) >= 1 THEN CAST(floor(date_diff('day', CAST(ts AS DATE), DATE '2030-01-01') / 365.25::DOUBLE) AS BIGINT) END AS floor_years FROM events""")
def time_rules(t):
    ts, k = F.col("ts"), F.col("event_id")
    iso = timefn.iso_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 2 == 0, "Z").otherwise("")))
    seen = timefn.observed(F.when(k % 3 == 0, ts), F.when(k % 3 == 1, ts), day())
    return t["events"].select("event_id", timefn.epoch_age(day(), "ts").alias("age_s"), F.date_format(iso, "yyyy-MM-dd HH:mm:ss").alias("parsed"), F.date_format(seen, "yyyy-MM-dd HH:mm:ss").alias("seen"), timefn.whole_years(F.datediff(F.lit("2030-01-01").cast("date"), ts.cast("date"))).alias("floor_years"))


# --- layouts and pages ----------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS doc, 'Python' || o_custkey || '|Skill mapping|SQL' AS skills FROM orders""")
def listed_skills(t):
    """Lines that may name skills: headings, context, endorsements, results, numbers and long lines go; repeats count once."""
    body = F.concat(F.lit("Skills\nAll\nPython"), F.col("o_custkey").cast("string"), F.lit("\nBack end at Firm\n3 endorsements\nPassed the assessment\nSkill mapping\n2 colleagues\nTools & Technologies\nSQL\n"), F.repeat(F.lit("long "), 20), F.lit("\nSQL\n· x\nPeople also viewed\nGo"))
    d = t["orders"].select(F.col("o_orderkey").alias("doc"), body.alias("text"))
    return layout.skill_lines(d, "doc", "text").select("doc", bars("skills").alias("skills"))


@query("""SELECT o_orderkey AS doc, 'Head of ' || o_custkey AS title, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE 'Orchard' END AS employer, '2018' AS "from", CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Mar 2021' END AS "to" FROM orders WHERE o_orderkey % 4 <> 2""")
def ambiguous_layouts(t):
    """A role that goes on, a type under a group, a bullet as title (no role), and a type without a group (no employer)."""
    who = F.concat(F.lit("Head of "), F.col("o_custkey").cast("string"))
    k = F.col("o_orderkey") % 4
    body = (
        F.when(k == 0, F.concat(who, F.lit("\nOrchard · Part-time\n2018 – Current · 4 yrs")))
        .when(k == 1, F.concat(F.lit("Orchard\nContract · 3 yrs\nLeeds · Hybrid\n"), who, F.lit("\nFull-time\n2018 - Mar 2021")))
        .when(k == 2, F.lit("● built it\nOrchard\n2018 - Mar 2021"))
        .otherwise(F.concat(who, F.lit("\nFull-time\n2018 - Mar 2021")))
    )
    d = t["orders"].select(F.col("o_orderkey").alias("doc"), body.alias("text"))
    return layout.open_ended(layout.experience_entries(d, "doc", "text")).select("doc", "title", "employer", "from", "to")


def _pages(t):
    """A page of each customer: no end of head, an svg, the name twice, the title only where it is named again."""
    customers = t["customer"].select("c_custkey", "c_nationkey").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")  # a few MB of keys, so one task or two, make pages that take far longer to read
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    head = F.lit("<html><head><title>no</title><style>p{}</style><body><svg><title>no</title></svg><p>one <i>of</i> many<table>")
    again = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(". Person "), k, F.lit(" - Head of Data."))).otherwise(".")
    body = F.concat(head, F.lit("<tr><td>Person "), k, F.lit(", our own 1st"), again, F.lit("<td>Works at Firm"), n, F.lit(" &amp; co</table><script>var a='<p>'</script><div>Person "), k, F.lit(" left Firm"), n, F.lit("x</div>"))
    return html.with_text(customers, "c_custkey", body), customers.select("c_custkey", F.col("c_custkey").alias("subject_id"), F.concat(F.lit("person "), k).alias("name"), F.concat(F.lit("Firm"), n, F.lit(" Pvt Ltd")).alias("employer"))


_OWN = "'Person ' || c_custkey || ', our own 1st' || CASE WHEN c_custkey % 2 = 0 THEN '. Person ' || c_custkey || ' - Head of Data.' ELSE '.' END"


@query(f"SELECT c_custkey, 'one' || chr(10) || 'of' || chr(10) || 'many' || chr(10) || {_OWN} || chr(10) || 'Works at Firm' || c_nationkey || ' & co' || chr(10) || 'Person ' || c_custkey || ' left Firm' || c_nationkey || 'x' AS text FROM customer")
def visible_text(t):
    """Blocks of visible text of made-up pages."""
    return _pages(t)[0].select("c_custkey", "text")


@query(f"""SELECT c_custkey, {_OWN} || chr(10) || 'Works at Firm' || c_nationkey || ' & co' AS win, CASE WHEN c_custkey % 2 = 0 THEN 'Head of Data' END AS title FROM customer""")
def corroborated(t):
    """The block that names the person with the next, where that names the employer, and the title beside the name."""
    p, who = _pages(t)
    return html.corroborations(p, "c_custkey", "text", who).select("c_custkey", F.col("window").alias("win"), "title")


@query(f"""WITH w AS (SELECT c_custkey AS s, {_OWN} || chr(10) || 'Works at Firm' || c_nationkey || ' & co' AS snippet, c_nationkey FROM customer)
SELECT s, 'employer' AS claim_type, 'firm' || c_nationkey || ' pvt ltd' AS claim_key, 'Firm' || c_nationkey || ' Pvt Ltd' AS claim_value, snippet FROM w UNION ALL SELECT s, 'title', 'head of data', 'Head of Data', snippet FROM w WHERE s % 2 = 0""")
def third_party_claims(t):
    p, who = _pages(t)
    best = html.corroborations(p, "c_custkey", "text", who).withColumn("url", F.lit("u"))
    return claims.page_claims(best, "employer", "title").select(F.col("subject_id").alias("s"), "claim_type", "claim_key", "claim_value", "snippet")


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'authwall' WHEN 1 THEN 'Join LinkedIn' WHEN 2 THEN 'Please verify you are a human' END AS marker, CASE o_orderkey % 4 WHEN 0 THEN 'busy' WHEN 1 THEN 'deepest' ELSE 'started' END AS more FROM orders""")
def page_markers(t):
    k = F.col("o_orderkey")
    page = F.element_at(text.strings(["x AUTHWALL y", "join linkedin now", "please Verify you are a human", "Sign in", "-"]), (k % 5 + 1).cast("int"))
    return t["orders"].select(k.alias("k"), panels.wall_marker(page).alias("marker"), panels.find_more(k % 4 == 0, F.when(k % 4 == 1, 3).otherwise(1), 3).alias("more"))


@query("""SELECT l_orderkey AS k, round(least(1.0, greatest(0.0, (l_quantity - 5) / 20)), 6) AS clamped, CASE WHEN l_quantity > 0 THEN round(least(1.0, ln(1 + l_extendedprice) / ln(1 + 500000::DOUBLE)), 6) ELSE 0 END AS depth, l_linenumber AS line FROM lineitem""")
def score_rules(t):
    return t["lineitem"].select(F.col("l_orderkey").alias("k"), scores.clamp((F.col("l_quantity") - 5) / 20).alias("clamped"), F.round(scores.depth(F.col("l_extendedprice")), 6).alias("depth"), F.col("l_linenumber").alias("line"))
