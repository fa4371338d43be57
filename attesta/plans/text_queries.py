"""Text, dictionary, URL, layout and page queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text, urls
from ..functions.constants import EMPLOYER_STOP, TITLE_CUES
from ..operators import claims, dictionary as D, html, layout, panels
from ..operators.scan import materialised
from ..sources import readers
from . import pipelines
from .registry import Registry

QUERIES = Registry()
query = QUERIES.query


def joined(c):
    return F.array_join(c, "|")


TERMS = [("The", "word", ["le", "der", "el"], []), ("And", "word", ["und", "et"], ["The"]), ("Of the", "phrase", [], ["And"]), ("Is", "word", ["est", "ist"], [])]
_ALIASES = "(VALUES ('the','The'),('le','The'),('der','The'),('el','The'),('and','And'),('und','And'),('et','And'),('ofthe','Of the'),('is','Is'),('est','Is'),('ist','Is')) a(key, name)"


def _terms(t):
    return readers.terms_frame(t["documents"].sparkSession, TERMS)


_W = "list_filter(regexp_split_to_array(text, '[^A-Za-z0-9+#.]+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, unnest({_W}) AS w, generate_subscripts({_W}, 1) AS i FROM documents),
l AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i AS pos, w || ' ' || w2 || ' ' || w3 AS win FROM l WHERE w3 IS NOT NULL UNION ALL SELECT doc_id, 10000000 + i, w || ' ' || w2 FROM l WHERE w2 IS NOT NULL UNION ALL SELECT doc_id, 20000000 + i, w FROM l),
h AS (SELECT doc_id, name, min(pos) AS pos FROM g JOIN {_ALIASES} ON regexp_replace(lower(win), '[^a-z0-9]', '', 'g') = key GROUP BY ALL)
SELECT doc_id, string_agg(name, '|' ORDER BY pos, name) AS names FROM h GROUP BY doc_id""")
def ngram_dictionary_lookup(t):
    return D.terms_in_text(t["documents"], "doc_id", "text", _terms(t)).select("doc_id", joined("names").alias("names"))


@query("""WITH h AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents) JOIN (VALUES ('the','The'),('and','And'),('is','Is')) a(key, name) ON w = key)
SELECT doc_id, string_agg(DISTINCT n, '|' ORDER BY n) AS held FROM (SELECT doc_id, name AS n FROM h UNION ALL SELECT doc_id, 'The' FROM h WHERE name = 'And') GROUP BY doc_id""")
def implied_union(t):
    words = t["documents"].select("doc_id", F.explode(text.signal_tokens("text")).alias("w"))
    dim = t["documents"].sparkSession.createDataFrame([("the", "The"), ("and", "And"), ("is", "Is")], "w string, name string")
    held = words.join(dim, "w").select("doc_id", "name").distinct()
    return D.with_implied(held, "doc_id", "name", _terms(t)).groupBy("doc_id").agg(joined(F.array_sort(F.collect_set("name"))).alias("held"))


@query("""WITH v AS (SELECT p_partkey, unnest(CASE WHEN p_name = '' THEN []::VARCHAR[] ELSE [p_name || ' Engineer', p_name || ' Developer'] END) AS v, lower(p_type || ' ' || p_name || ' developer senior') AS head FROM part),
m AS (SELECT p_partkey, len(list_filter(regexp_split_to_array(lower(v), '[^a-z0-9+#]+'), lambda x: x <> '' AND NOT list_contains(regexp_split_to_array(head, '[^a-z0-9+#]+'), x))) = 0 AS ok FROM v) SELECT p_partkey, bool_or(ok) AS matches FROM m GROUP BY 1""")
def title_variant_match(t):
    p = t["part"]
    head = F.concat_ws(" ", "p_type", "p_name", F.lit("developer senior"))
    return p.select("p_partkey", text.title_matches(head, F.array(F.concat("p_name", F.lit(" Engineer")))).alias("matches"))


@query("""WITH c AS (SELECT n_nationkey, r_name || '-' || n_name AS code FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, code, starts_with(code, 'ASIA') OR starts_with(code, 'EUROPE-FRANCE') OR starts_with('EUROPE-FRANCE', code) AS compatible FROM c""")
def region_prefix_compat(t):
    c = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("-", "r_name", "n_name").alias("code"))
    return c.withColumn("compatible", D.compatible(F.col("code"), text.strings(["ASIA", "EUROPE-FRANCE"])))


@query("""WITH c AS (SELECT c_custkey % 100 AS k, unnest([r_name, r_name || '-' || n_name]) AS code FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
d AS (SELECT DISTINCT k, code FROM c) SELECT k, string_agg(code, '|' ORDER BY length(code) DESC, code) AS codes FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.k = d.k AND e.code <> d.code AND starts_with(e.code, d.code)) GROUP BY k""")
def regions_drop_covered(t):
    c = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select((F.col("c_custkey") % 100).alias("k"), F.explode(F.array("r_name", F.concat_ws("-", "r_name", "n_name"))).alias("code")).groupBy("k").agg(joined(D.drop_covered(F.collect_set("code"))).alias("codes"))


@query("""WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS w FROM documents) SELECT doc_id, CASE WHEN list_contains(w, 'the') AND list_contains(w, 'and') THEN 'the_and' WHEN list_contains(w, 'der') THEN 'der' END AS banned FROM w""")
def banned_token_filter(t):
    return t["documents"].select("doc_id", text.banned_signal(F.lit(None).cast("string"), "text", ["the_and", "der"]).alias("banned"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'password') THEN 'Password' WHEN contains(lower(text), 'license') THEN 'LICENSE' WHEN contains(lower(text), 'und ') THEN 'Und ' END AS excluded FROM documents""")
def excluded_substring(t):
    return t["documents"].select("doc_id", text.first_excluded([F.col("text")], text.strings(["Password", "LICENSE", "Und "])).alias("excluded"))


@query("""WITH b AS (SELECT item_id, text AS s FROM benchmark WHERE length(text) > 0) SELECT doc_id, count(*) AS n FROM documents JOIN b ON contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(s, '\\s+', ' ', 'g')))) GROUP BY doc_id""")
def quotable_containment(t):
    """Benchmark passages that documents quote: candidates share up to six of the passage's words, then containment decides."""
    words = lambda c: F.split(text.squeezed(c), " ")
    # words at a passage's ends may be glued to others in a document: the key takes inner ones
    b = t["benchmark"].where("length(text) > 0").select("item_id", F.col("text").alias("s"), F.least(F.lit(6), F.size(words("text")) - 2).alias("n"))
    keyed = b.where("n > 0").select("item_id", "s", "n", F.array_join(F.slice(words("s"), F.lit(2), F.col("n")), " ").alias("key"))
    d = t["documents"].select("doc_id", "text")
    windows = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (F.col("n") - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.col("n")), " ")))
    lengths = F.broadcast(keyed.select("n").distinct())  # six at most
    grams = d.crossJoin(lengths).select("doc_id", F.explode(text.bound(words("text"), windows)).alias("key"))
    hits = grams.join(keyed.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    pairs = hits.join(b.select("item_id", "s"), "item_id").join(d, "doc_id").where(text.quotable(F.col("s"), F.col("text"))).select("doc_id")
    # passages of one or two words have no inner word
    short = d.where("text IS NOT NULL").join(b.where("n <= 0").select("s"), text.quotable(F.col("s"), F.col("text"))).select("doc_id")
    return pairs.unionByName(short).groupBy("doc_id").agg(F.count("*").alias("n"))


_JD = "CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 7)::VARCHAR || '-' || (o_orderkey % 11)::VARCHAR || ' years' WHEN 1 THEN 'at least ' || (o_orderkey % 9)::VARCHAR || ' years' WHEN 2 THEN (o_orderkey % 12)::VARCHAR || '+ years of it' WHEN 3 THEN (o_orderkey % 4)::VARCHAR || ' to ' || (o_orderkey % 13)::VARCHAR || ' years' ELSE 'no demands' END"


@query(f"""WITH j AS (SELECT o_orderkey, {_JD} AS t FROM orders), r AS (SELECT *, try_cast(regexp_extract(t, '(\\d+)\\s*(-|to)\\s*(\\d+) y', 1) AS INTEGER) AS a, try_cast(regexp_extract(t, '(\\d+)\\s*(-|to)\\s*(\\d+) y', 3) AS INTEGER) AS b, try_cast(regexp_extract(t, '(\\d+)\\+? years', 1) AS INTEGER) AS c FROM j)
SELECT o_orderkey, CASE WHEN a IS NOT NULL THEN least(a, b) ELSE c END AS min_years, CASE WHEN a IS NOT NULL THEN greatest(a, b) END AS max_years FROM r""")
def years_from_text(t):
    k = F.col("o_orderkey")
    m = lambda n: (k % n).cast("string")
    jd = F.when(k % 5 == 0, F.concat(m(7), F.lit("-"), m(11), F.lit(" years"))).when(k % 5 == 1, F.concat(F.lit("at least "), m(9), F.lit(" years"))).when(k % 5 == 2, F.concat(m(12), F.lit("+ years of it"))).when(k % 5 == 3, F.concat(m(4), F.lit(" to "), m(13), F.lit(" years"))).otherwise("no demands")
    return t["orders"].select("o_orderkey", text.years_from_text(jd).alias("y")).select("o_orderkey", "y.min_years", "y.max_years")


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1)) AS slug FROM pages""")
def url_canonicalise(t):
    return t["pages"].select("page_id", urls.registered_host("url").alias("host"), urls.slug("url").alias("slug"))


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages) SELECT page_id, host, host LIKE '%.com' OR host = 'com' OR host LIKE '%.example.org' OR host = 'example.org' AS blocked FROM h""")
def host_block(t):
    h = urls.host("url")
    return t["pages"].select("page_id", h.alias("host"), urls.blocked(h, ["com", "example.org"]).alias("blocked"))


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages), r AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN u ELSE u || '?q=a+b&Token=REDACTED&empty=&x=%C3%A9~%2A&apikey=REDACTED#f' END AS redacted FROM u)
SELECT page_id, redacted, sha256(redacted) AS url_hash FROM r""")
def url_redact_hash(t):
    """Secrets go, other parameters are encoded anew; addresses without a query stay."""
    plain = F.regexp_replace("url", "[?#].*$", "")
    u = F.when(F.col("page_id") % 2 == 0, plain).otherwise(F.concat(plain, F.lit("?q=a%20b&Token="), F.col("page_id").cast("string"), F.lit("&empty&x=é~*&&apikey=z#f")))
    return t["pages"].select("page_id", urls.redact_url(u).alias("redacted"), urls.url_hash(u).alias("url_hash"))


_LINES = "replace(replace(coalesce(html, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_TAGS = rf"""regexp_replace(regexp_replace(regexp_replace({_LINES}, '(?s)^.*</head>', ''), '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*(>|$)', chr(10), 'g')"""
#: A name that HTML reads without its semicolon, as titles can be cut after it; ampersands last, as nothing is decoded twice.
_VISIBLE = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({_TAGS}, '&copy;?', chr(169), 'g'), '&middot;?', chr(183), 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')"""
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"  #: all white space, as the query folds it
#: Blocks of the driver's pages: each tag ends a text node there, and a page can end within a tag.
_BLOCKS = rf"""b AS (SELECT page_id, list_filter(list_transform(string_split({_VISIBLE}, chr(10)), lambda x: trim(regexp_replace(x, '{_SPACE}', ' ', 'g'))), lambda x: x <> '') AS b FROM pages)"""


@query(f"WITH {_BLOCKS} SELECT page_id, array_to_string(b, chr(10)) AS text FROM b")
def page_text(t):
    """Visible text of the pages, a text node a line."""
    return html.with_text(t["pages"], "page_id", "html")


def _people(t):
    """The pages' texts, and for each page a person and employer: the first eight words of its first block of as many."""
    p = materialised(html.with_text(t["pages"], "page_id", "html"))  # pages are parsed once
    words = F.get(F.filter(F.transform(F.split("text", "\n"), lambda x: F.split(x, " ")), lambda w: F.size(w) > 7), F.lit(0))
    said = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    return p, p.select("page_id", words.alias("w")).where("w IS NOT NULL").select("page_id", F.col("page_id").alias("subject_id"), said(1, 6).alias("name"), said(7, 2).alias("employer"))


_SQL_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_SQL_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
_PEOPLE = f"""f AS (SELECT page_id, b, string_split(list_filter(b, lambda x: len(string_split(x, ' ')) > 7)[1], ' ') AS w FROM b), n AS (SELECT page_id, b, array_to_string(w[1:6], ' ') AS name, w[7] || ' ' || w[8] AS employer FROM f WHERE w IS NOT NULL),
k AS (SELECT *, CASE WHEN list_has_any({_SQL_WORDS.format('employer')}, {_SQL_LIST(TITLE_CUES)}) THEN [] ELSE list_filter(list_distinct({_SQL_WORDS.format('employer')}), lambda x: length(x) >= 2 AND NOT list_contains({_SQL_LIST(EMPLOYER_STOP)}, x)) END AS keys FROM n)"""


@query(f"""WITH {_BLOCKS}, {_PEOPLE}, e AS (SELECT *, unnest(b) AS x, generate_subscripts(b, 1) AS i FROM k),
h AS (SELECT *, CASE WHEN list_has_any({_SQL_WORDS.format('x')}, keys) THEN x WHEN i < len(b) AND list_has_any({_SQL_WORDS.format('b[i + 1]')}, keys) THEN x || chr(10) || b[i + 1] END AS v FROM e WHERE contains(lower(x), lower(name))),
m AS (SELECT *, strpos(lower(v), lower(name)) - 1 AS a, strpos(lower(v), lower(name)) - 1 + length(name) AS z, length(v) AS l FROM h WHERE v IS NOT NULL),
o AS (SELECT *, greatest(a - 160, 0) AS lo, least(z + 160, l) AS hi FROM m), s AS (SELECT *, strpos(substr(v, lo + 1, a - lo + 1), ' ') AS sp, strpos(reverse(substr(v, z + 1, hi - z)), ' ') AS ep FROM o),
c AS (SELECT *, CASE WHEN lo = 0 THEN 0 WHEN sp = 0 THEN a ELSE lo + sp END AS st, CASE WHEN hi = l OR ep = 0 THEN hi ELSE hi - ep END AS en FROM s)
SELECT page_id, min(i - 1) AS pos, CASE WHEN l <= 320 THEN v ELSE trim(substr(v, st + 1, en - st), ' ' || chr(10)) END AS win FROM c GROUP BY page_id, 3""")
def block_proximity(t):
    """Windows in which pages name a person (six words that they begin with) beside the employer (the two words after)."""
    p, people = _people(t)
    return html.windows(p, "page_id", "text", people).select("page_id", "pos", F.col("window").alias("win"))


@query(f"""WITH {_BLOCKS}, {_PEOPLE}, p AS (SELECT min(page_id) AS s, ' ' || array_to_string({_SQL_WORDS.format('name')}, ' ') || ' ' AS name, any_value(keys) AS keys FROM k WHERE len(keys) > 0 AND len({_SQL_WORDS.format('name')}) > 0 GROUP BY k.name, employer),
e AS (SELECT page_id, b, unnest(b) AS x, generate_subscripts(b, 1) AS i FROM b), w AS (SELECT page_id, i, {_SQL_WORDS.format('x')} AS own, {_SQL_WORDS.format("coalesce(b[i + 1], '')")} AS after FROM e),
v AS (SELECT *, ' ' || array_to_string(own, ' ') || ' ' AS line FROM w)
SELECT page_id, s AS subject_id, i - 1 AS block, CASE WHEN list_has_any(own, keys) THEN 0 ELSE 1 END AS distance FROM v JOIN p ON contains(line, name) AND (list_has_any(own, keys) OR list_has_any(after, keys))""")
def co_mentions(t):
    """Every person of the pages (one for each name and employer), looked for in all pages: blocks with the name word by
    word, an employer's word in them or next."""
    p, people = _people(t)
    each = materialised(people.groupBy("name", "employer").agg(F.min("subject_id").alias("subject_id")))
    return html.mentions(html.postings(p, "page_id", "text"), "page_id", each)


@query("""WITH d AS (SELECT o_orderkey AS doc, 'Engineer ' || o_custkey AS title, 'Firm ' || (o_custkey % 50) AS firm, o_orderkey % 3 AS kind FROM orders)
SELECT doc, title, firm AS employer, CASE kind WHEN 0 THEN 'Jan 2019' WHEN 1 THEN 'Feb 2020' ELSE '2016' END AS "from", CASE kind WHEN 0 THEN 'Present' WHEN 1 THEN 'Mar 2021' ELSE '2018' END AS "to" FROM d
UNION ALL SELECT doc, 'Lead', firm, 'Apr 2021', 'Present' FROM d WHERE kind = 1""")
def line_layout_entries(t):
    """Three layouts made from orders: a company line, a promotion group with two roles, and two plain lines."""
    title, firm = F.concat(F.lit("Engineer "), F.col("o_custkey").cast("string")), F.concat(F.lit("Firm "), (F.col("o_custkey") % 50).cast("string"))
    nl = F.lit("\n")
    one = F.concat(title, nl, firm, F.lit(" · Full-time\nJan 2019 - Present · 2 yrs"))
    two = F.concat(firm, F.lit("\n3 yrs 2 mos\nDelhi, India · Remote\n"), title, F.lit("\nFeb 2020 – Mar 2021 · 1 yr\nLead\nFull-time\nApr 2021 - Present\nMore profiles for you\nOther\nElse · Contract\n2010 - 2012"))
    body = F.when(F.col("o_orderkey") % 3 == 0, one).when(F.col("o_orderkey") % 3 == 1, two).otherwise(F.concat(title, nl, firm, F.lit("\n2016 - 2018")))
    d = t["orders"].select(F.col("o_orderkey").alias("doc"), body.alias("text"))
    return layout.experience_entries(d, "doc", "text").select("doc", "title", "employer", "from", "to")


@query("""SELECT o_orderkey AS doc, 'Institute ' || (o_custkey % 9) AS institution, 'Bachelor' AS degree FROM orders""")
def education_layout(t):
    d = t["orders"].select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("Institute "), (F.col("o_custkey") % 9).cast("string"), F.lit(" · city\nBachelor · Arts\n2012 – 2016")).alias("text"))
    return layout.education_entries(d, "doc", "text").select("doc", "institution", "degree")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS snippet, CASE c_custkey % 4 WHEN 0 THEN 'artifact_backed' WHEN 1 THEN 'self_reported' WHEN 2 THEN 'third_party_stated' ELSE 'rumour' END AS tier,
CASE WHEN c_custkey % 5 = 0 THEN 'college tier' ELSE c_mktsegment END AS key, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) || '  says' ELSE 'nothing' END AS src FROM customer)
SELECT c_custkey, CASE WHEN snippet = '' THEN 'skill: empty snippet' WHEN tier = 'rumour' THEN 'skill: unknown tier ''rumour''' WHEN key = 'college tier' THEN 'skill: names banned signal ''college_tier''' WHEN NOT contains(lower(src), lower(snippet)) THEN 'skill: snippet not found in source' END AS reason FROM c""")
def claim_refusals(t):
    k = F.col("c_custkey")
    rows = t["customer"].select(
        "c_custkey", F.lit("skill").alias("claim_type"), F.when(k % 11 == 0, "").otherwise(F.col("c_name")).alias("snippet"),
        F.when(k % 4 == 0, "artifact_backed").when(k % 4 == 1, "self_reported").when(k % 4 == 2, "third_party_stated").otherwise("rumour").alias("tier"),
        F.when(k % 5 == 0, "college tier").otherwise(F.col("c_mktsegment")).alias("claim_key"), F.lit("x").alias("claim_value"),
        F.when(k % 2 == 0, F.concat(F.upper("c_name"), F.lit("  says"))).otherwise("nothing").alias("source_text"),
    )
    return rows.select("c_custkey", claims.refusal(F.col("source_text"))["reason"].alias("reason"))


@query("""WITH s AS (SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT *, CASE s_suppkey % 4 WHEN 0 THEN 'Java Developer' WHEN 1 THEN 'Cook' ELSE 'Senior Backend Engineer' END AS title, CASE s_suppkey % 5 WHEN 0 THEN 'Dubai, UAE' WHEN 1 THEN 'Nowhere' WHEN 2 THEN 'Pune, India' WHEN 3 THEN '' ELSE 'Karnataka, India' END AS loc FROM s)
SELECT s_suppkey, CASE WHEN title = 'Cook' THEN 'title: ''Cook'' does not match Backend Engineer | Java Engineer' WHEN s_suppkey % 7 = 0 THEN 'employer: excluded (Acme)' WHEN loc = 'Dubai, UAE' THEN 'location: Dubai, UAE is outside India' WHEN loc = 'Nowhere' THEN 'location: Nowhere is not a recognised Indian location'
 WHEN loc = 'Pune, India' THEN 'location: Pune, India (IN-MH-PNQ) is outside IN-KA-BLR' END AS reason, NOT (title = 'Cook' OR s_suppkey % 7 = 0 OR loc IN ('Dubai, UAE', 'Nowhere')) AS passed FROM x""")
def snippet_gate_refs(t):
    spark = t["supplier"].sparkSession
    k = F.col("s_suppkey")
    loc = F.when(k % 5 == 0, "Dubai, UAE").when(k % 5 == 1, "Nowhere").when(k % 5 == 2, "Pune, India").when(k % 5 == 3, "").otherwise("Karnataka, India")
    refs = t["supplier"].select(
        k.alias("ref_id"), F.lit("r").alias("req_id"), F.when(k % 4 == 0, "Java Developer").when(k % 4 == 1, "Cook").otherwise("Senior Backend Engineer").alias("title"),
        F.lit(None).cast("string").alias("headline"), F.when(k % 7 == 0, "ACME Corp").otherwise("Other").alias("employer"), F.lit("").alias("raw"), loc.alias("location"),
    )
    req = spark.createDataFrame([("r", ["Backend Engineer"], ["Java"], ["Acme"], ["IN-KA-BLR"], "hybrid")], "req_id string, titles array<string>, must_have array<string>, excluded_employers array<string>, regions array<string>, remote string")
    regions = spark.createDataFrame([("IN-KA", "Karnataka"), ("IN-MH-PNQ", "Pune"), ("IN-KA-BLR", "Bengaluru")], "code string, place string")
    return pipelines.gated(refs, req, regions).select(F.col("ref_id").alias("s_suppkey"), F.col("verdict.reason").alias("reason"), F.col("verdict.passed").alias("passed"))


@query("""WITH r AS (SELECT l_suppkey AS s, l_orderkey AS repo, p_brand AS lang, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT s, repo, lang, bytes, round(share, 6) AS share FROM (SELECT *, bytes / sum(bytes) OVER (PARTITION BY s, repo) AS share FROM r) WHERE share >= 0.1 AND lang <> 'Brand#1'""")
def language_share(t):
    r = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("subject_id"), F.col("l_orderkey").alias("repo"), "p_brand").agg(F.sum("l_quantity").cast("long").alias("bytes"))
    repos = r.groupBy("subject_id", "repo").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "bytes"))).alias("languages"))
    return claims.language_shares(repos, ["brand#1"]).select(F.col("subject_id").alias("s"), "repo", F.col("language").alias("lang"), "bytes", F.round("share", 6).alias("share"))


@query("""SELECT event_id, CASE WHEN value / 100 >= 0.55 THEN 'Strong match' WHEN value / 100 >= 0.4 THEN 'Good match' WHEN value / 100 >= 0.25 THEN 'Possible match' ELSE 'Weak' END AS label, CASE WHEN value = 0 THEN 0 ELSE greatest(1, least(5, CAST(round_even(value / 20, 0) AS INTEGER))) END AS segments FROM events""")
def label_segments(t):
    v = F.col("value") / 100
    return t["events"].select("event_id", scores.label(v).alias("label"), scores.segments(v).alias("segments"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', 0) AS m FROM documents) SELECT doc_id, sha256(lower(m)) AS email FROM m WHERE m <> ''""")
def strong_keys(t):
    return t["documents"].select("doc_id", urls.strong_keys("text")["email_sha256"].alias("email")).where("email IS NOT NULL")


@query("""SELECT p_partkey, CASE WHEN b < 1024 THEN printf('%.0f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024.0::DOUBLE, 1)) ELSE printf('%.1f MB', round(b / 1048576.0::DOUBLE, 1)) END AS shown FROM (SELECT p_partkey, p_partkey * p_size AS b FROM part)""")
def human_bytes(t):
    return t["part"].select("p_partkey", text.human_bytes(F.col("p_partkey") * F.col("p_size")).alias("shown"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE n_chars > 1000) AS long FROM documents GROUP BY 1""")
def documents_by_source(t):
    return t["documents"].groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") > 1000).alias("long"))


@query(rf"""WITH {_BLOCKS}, t AS (SELECT page_id, array_to_string(b, chr(10)) AS t FROM b), w AS (SELECT *, regexp_matches(lower(t), 'join linkedin|authwall|sign in to see') AS walled FROM t)
SELECT page_id, length(t) > 5000 AND NOT walled AS rendered, walled AS authwalled, contains(lower(t), 'experience') AS has_experience,
  CAST(len(regexp_extract_all(t, '(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\.?\s+\d{{4}}\s*(-|–|—)\s*(Present|[A-Z][a-z]{{2}}\w*\.?\s+\d{{4}})')) AS INTEGER) AS dated_entries FROM w""")
def page_classifier(t):
    """What each page shows: rendered, authwalled, has_experience and its number of dated ranges."""
    return html.with_text(t["pages"], "page_id", "html").select("page_id", *panels.page_fields(F.col("text")))


@query("""WITH e AS (SELECT user_id, epoch(ts) AS s FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) < 21600 THEN 0 ELSE 1 END AS new FROM e),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s) AS k FROM g) SELECT user_id, CAST(floor(min(s)) AS BIGINT) AS start_s, count(*) AS n FROM n GROUP BY user_id, k""")
def activity_sessions(t):
    e = t["events"].select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_seconds("w.start").alias("start_s"), "n")


@query("""SELECT doc_id, CASE WHEN n_chars = 0 THEN '' ELSE source END AS source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 30""")
def capped_per_owner(t):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t["documents"].withColumn("r", F.row_number().over(w)).where("r <= 30").select("doc_id", "source")
