"""Domain semantics on inline fixtures: nulls, goldens, ordered gates, layouts, identities, queue states, streams."""

import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions import constants, scores, text, timefn, urls
from attesta.operators import claims, dictionary, gate, html, htmltree, identity, jobs, layout, panels, relational, reports, scoring
from attesta.plans import matching_queries, pipelines
from attesta.sources import readers
from attesta.streaming import mirrors

NOW = dt.datetime(2026, 8, 26)
REQ = matching_queries.REQ


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def golden_score(spark):
    """A hand-built subject whose score is known."""
    now = F.lit("2026-08-26").cast("timestamp")
    r = spark.createDataFrame([("g", "tech", ["Backend Engineer"], ["Python", "PostgreSQL"], ["Kubernetes"], 4, ["IN-KA-BLR"], "hybrid", 540)], REQ)
    c = spark.createDataFrame(
        [("s", "skill", "Python", "Python", 100000.0, "artifact_backed", True), ("s", "skill", "PostgreSQL", "PostgreSQL", 100000.0, "artifact_backed", True), ("s", "location", "IN-KA-BLR", None, None, "self_reported", False),
         ("s", "experience_years", None, None, 6.0, "self_reported", False), ("s", "availability", None, None, None, "self_reported", False)],
        "subject_id string, claim_type string, claim_key string, claim_value string, value_num double, tier string, dated boolean",
    ).withColumn("observed_at", F.when(F.col("dated"), now))
    return scoring.evaluate(r, c, now, c.select(F.lit("g").alias("req_id"), "subject_id")).select("subject_id", *constants.COMPONENTS, "score", "passed")


def test_golden(spark):
    r = golden_score(spark).first()
    assert r.score == 0.942137 and r.passed and r.skill_match == 0.833333


def evaluate(spark, rows, **req):
    spec = {"req_id": "r", "profile": "tech", "titles": ["x"], "must_have": ["Python", "SQL"], "nice_to_have": ["Go"], "min_years": 4, "regions": ["IN-KA-BLR"], "remote": "hybrid", "max_staleness_days": 540} | req
    r = spark.createDataFrame([tuple(spec[k.split()[0]] for k in REQ.split(", "))], REQ)
    c = spark.createDataFrame([("s", *x) for x in rows], "subject_id string, claim_type string, claim_key string, claim_value string, value_num double, tier string, observed_at timestamp")
    return scoring.evaluate(r, c, F.lit(NOW), c.select(F.lit("r").alias("req_id"), "subject_id")).first()


def test_scoring_semantics(spark):
    day = lambda n: NOW - dt.timedelta(days=n)
    none_held = evaluate(spark, [("experience_years", None, None, 10.0, "self_reported", None)])
    assert none_held.seniority_fit == 1.0 and none_held.score == 0.05 and none_held.gate_must_have.startswith("pass: has 0 of 2") and none_held.gate_activity.startswith("skip") and none_held.passed
    free = evaluate(spark, [("experience_years", None, None, 10.0, "self_reported", None)], must_have=[], nice_to_have=[])
    assert free.score == 0.2 and free.skill_match == 0.0
    half = evaluate(spark, [("skill", "Python", None, 500000.0, "artifact_backed", day(365)), ("location", None, "Berlin, Germany", None, "self_reported", None)])
    assert half.skill_depth == 0.25 and half.activity_recency == 0.5 and half.gate_location == "fail: Berlin, Germany is outside IN-KA-BLR" and not half.passed
    assert half.seniority_basis == "estimated"
    stale = evaluate(spark, [("skill", "Python", None, 1.0, "artifact_backed", day(541)), ("location", "IN-MH", None, None, "self_reported", None)])
    assert stale.gate_activity == "fail: most recent public work 541 days old, limit 540" and "would need to relocate" in stale.gate_location
    unknown = evaluate(spark, [("location", "IN-KA", None, None, "self_reported", None)], min_years=2)
    assert unknown.seniority_basis == "unknown" and unknown.seniority_fit == 0.0
    banned = evaluate(spark, [("skill", "gender", None, 1.0, "artifact_backed", day(1))])
    assert banned.activity_recency == 0.0
    assert evaluate(spark, [("location", "IN", None, None, "self_reported", None)], regions=["IN-REMOTE"]).gate_location == "pass"


def test_text_functions(spark):
    r = one(
        spark,
        variants=text.title_variants(F.lit("Backend Engineers team")), none=text.title_variants(F.lit("Chef")), empty=text.title_variants(F.lit("")),
        hit=text.title_matches(F.lit("Sr. Backend Developer at Acme"), text.strings(["Backend Engineer"])), miss=text.title_matches(F.lit("Frontend Developer"), text.strings(["Backend Engineer"])),
        india=text.mentions_country(F.lit("Karnataka, INDIA")), indiana=text.mentions_country(F.lit("Indiana")),
        y1=text.years_from_text(F.lit("8-5 years")), y2=text.years_from_text(F.lit("At least 3 years")), y3=text.years_from_text(F.lit("5+ years")), y4=text.years_from_text(F.lit("none")),
        reason=text.plain_reason(F.lit("title: no headline")), bytes=text.human_bytes(F.lit(1536)), small=text.human_bytes(F.lit(5)), posts=text.first_integer(F.lit("1,234 posts")), age=text.relative_age(F.lit("3 weeks ago")),
        split=text.time_split(F.lit("2016 - 2020 · 4 yrs")), single=text.time_split(F.lit("2016")), q=text.quotable(F.lit("A  b"), F.lit("x a B y")), clause=text.or_clause(text.strings(["a b", "c", "c"])),
        windows=text.window_keys(F.lit("A b. #c")), commas=text.comma_list(F.lit(" a, ,b ")), routes=text.keyword_routes(F.lit("Senior Data engineer"), {"x": ["data"], "y": ["ops"]}),
        banned=text.banned_signal(F.lit("College of Commerce"), F.lit(None).cast("string"), ["college_tier", "age"]), page=text.banned_signal(F.lit("Age"), F.lit("page"), ["college_tier", "age"]),
        parted=text.banned_signal(F.lit("college"), F.lit("tier one"), ["college_tier"]), y5=text.years_from_text(F.lit("at least 3 languages")), y6=text.years_from_text(F.lit("minimum of 4 years")), y7=text.years_from_text(F.lit("min. 4 years")),
        plain=text.plain_reason(F.lit("must: no evidence for Go")), nothing=text.plain_reason(F.lit("x: ")),
    )
    assert r.variants == ["Backend Engineer team", "Backend Developer team", "Backend Programmer team", "Backend SDE team"] and r.none == ["Chef"] and r.empty == []
    assert r.hit and not r.miss and r.india and not r.indiana
    assert [tuple(y) for y in (r.y1, r.y2, r.y3, r.y4)] == [(5, 8), (3, None), (5, None), (None, None)]
    assert r.reason == "No headline" and r.bytes == "1.5 KB" and r.small == "5 B" and r.posts == 1234 and r.age == "3 weeks ago"
    assert tuple(r.split) == ("2016", "2020", "4 yrs") and tuple(r.single)[:2] == ("2016", "2016") and r.q and r.clause == '("a b" OR c)'
    assert [tuple(w) for w in r.windows] == [(0, 0, "abc"), (1, 0, "ab"), (1, 1, "bc"), (2, 0, "a"), (2, 1, "b"), (2, 2, "c")] and r.commas == ["a", "b"] and r.routes == ["x"]
    assert r.banned is None and r.page == "age" and r.parted is None
    assert [tuple(y) for y in (r.y5, r.y6, r.y7)] == [(None, None), (4, None), (4, None)] and (r.plain, r.nothing) == ("No public sign of Go", "No reason recorded")


def test_dates(spark):
    months = ["Jan 2020", "September 2019", "2018", "Present", "junk", "", None, "Sept. 2021"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(months)], "i int, m string").select("i", timefn.parse_month("m").alias("d"))
    assert [str(x.d) for x in df.orderBy("i").collect()] == ["2020-01-01", "2019-09-01", "2018-01-01", "None", "None", "None", "None", "2021-09-01"]
    iv = spark.createDataFrame([("a", "2020-01-01", "2021-01-01"), ("a", "2020-06-01", "2022-01-01"), ("a", "2023-01-01", None), ("a", None, None), ("a", "2030-01-01", None)], "k string, s string, e string").selectExpr("k", "cast(s as date) s", "cast(e as date) e")
    out = relational.union_years(timefn.spans(iv, "s", "e", F.lit(dt.date(2024, 1, 1))), "k", "s", "e").first()
    assert out.days == 731 + 365 and out.years == 3.0
    r = one(spark, d=timefn.decay(F.lit(365.0)), n=timefn.days_between(F.lit(NOW), F.lit(NOW + dt.timedelta(1))), w=timefn.whole_years(F.lit(300.0)), seg=scores.segments(F.lit(0.5)), none=scores.label(F.lit(None).cast("double")))
    assert (r.d, r.n, r.w, r.seg, r.none) == (0.5, 0.0, None, 2, "Not yet ranked")


def test_urls(spark):
    r = one(
        spark, a=urls.profile_url(F.lit("in.linkedin.com/in/Jane-D/?x=1")), b=urls.profile_url(F.lit("https://linkedin.com/company/x")), c=urls.profile_url(F.lit("https://evil.com/in/x")),
        h=urls.redact_url(F.lit("http://x/y?a=1&api_key=Z#f")), l=urls.login_from_url(F.lit("https://github.com/Octo-Cat?tab=1")), o=urls.login_from_url(F.lit("https://github.com/orgs/x")), blk=urls.blocked(F.lit("a.b.com"), ["b.com"]), nb=urls.blocked(F.lit("ab.com"), ["b.com"]), k=urls.strong_keys(F.lit("see https://x.y, (https://github.com/orgs/a) https://github.com/Me and A+1@B-c.co")), none=urls.host(F.lit("not a url")),
    )
    assert r.a == "linkedin.com/in/jane-d" and r.b is None and r.c is None and r.h == "http://x/y?a=1&api_key=REDACTED#f"
    assert (r.l, r.o, r.blk, r.nb, r.none) == ("octo-cat", None, True, False, None) and r.k == {"github_login": "me", "email_sha256": hashlib.sha256(b"a+1@b-c.co").hexdigest()}


def test_relational_nulls_and_ties(spark):
    old = spark.createDataFrame([("s", None, 1, "t1")], "k string, n string, v int, tier string")
    new = spark.createDataFrame([("s", None, 2, "t2"), ("s", "x", 3, "t3"), ("s", "x", 4, "t4")], old.schema)
    got = {(r.k, r.n): (r.v, r.tier) for r in relational.upsert(old, new, ["k", "n"], ["v"], ["v"]).collect()}
    assert got == {("s", None): (2, "t1"), ("s", "x"): (4, "t3")}
    assert sorted((r.n or "", r.v) for r in relational.insert_ignore(old, new, ["k", "n"], [F.asc("v")]).collect()) == [("", 1), ("x", 3)]
    p = spark.createDataFrame([("a", "w", 1), ("*", "w", 9)], "d string, s string, cap int")
    x = spark.createDataFrame([("a", "w"), ("b", "w"), ("b", "z")], "d string, s string")
    assert sorted((r.d, r.cap or 0) for r in relational.wildcard_join(x, p, "d", "s", "cap").collect()) == [("a", 1), ("b", 0), ("b", 9)]


def test_dictionary(spark):
    terms = readers.terms_frame(spark, [("C", "language", [], []), ("C++", "language", [], []), ("C#", "language", ["csharp"], []), ("Node.js", "tool", [], ["JavaScript"])])
    d = spark.createDataFrame([(1, "node js and C work"), (2, None)], "id int, t string")
    assert dictionary.terms_in_text(d, "id", "t", terms).first().names == ["Node.js", "C#"]  # later entries win a collision
    held = spark.createDataFrame([("s", "Node.js")], "s string, term string")
    assert {r.term for r in dictionary.with_implied(held, "s", "term", terms).collect()} == {"Node.js", "JavaScript"}
    regions = spark.createDataFrame([("IN", "India"), ("IN-KA", "Karnataka"), ("IN-KA-BLR", "Bengaluru"), ("IN-DL", "Delhi"), ("IN-DL-NCR", "Delhi")], "code string, place string")
    q = spark.createDataFrame([(1, "Bengaluru, Karnataka, India"), (2, "Greater Delhi Area"), (3, "Nowhere"), (4, "India")], "id int, t string")
    assert {r.id: r.region for r in dictionary.region_of(q, "id", "t", regions).collect()} == {1: "IN-KA-BLR", 2: "IN-DL-NCR", 3: None, 4: "IN"}
    assert {r.id: r.codes for r in dictionary.regions_in_text(q, "id", "t", regions).collect()}[1] == ["IN-KA-BLR"]
    _, misses = dictionary.canonical(spark.createDataFrame([("csharp",), ("zig",), ("zig",)], "raw string"), "raw", terms)
    assert [r.raw for r in misses.collect()] == ["zig", "zig"]


def test_gate_and_rescue(spark):
    regions = spark.createDataFrame([("IN-KA", "Karnataka"), ("IN-MH-PNQ", "Pune")], "code string, place string")
    req = spark.createDataFrame([("r", ["Backend Engineer"], ["Java"], ["Acme"], ["IN-KA-BLR"], "hybrid")], "req_id string, titles array<string>, must_have array<string>, excluded_employers array<string>, regions array<string>, remote string")
    rows = [(1, None, None, None), (2, "Chef", None, None), (3, "Java Developer", "Ex-ACME | x", None), (4, "Backend SDE", None, "Dubai, UAE"), (5, "Backend SDE", None, "Indiana"), (6, "Backend SDE", None, "Pune, India"), (7, "Backend SDE", None, "Goa, India"), (8, "Backend SDE", None, None), (9, "Backend SDE", None, "Karnataka")]
    refs = spark.createDataFrame([(i, "r", t, h, None, None, loc) for i, t, h, loc in rows], "ref_id int, req_id string, title string, headline string, employer string, raw string, location string")
    out = {r.ref_id: r.verdict for r in pipelines.gated(refs, req, regions).collect()}
    assert out[1].reason == "title: no title or headline in snippet to test" and out[2].reason == "title: 'Chef' does not match Backend Engineer | Java Engineer"
    assert out[3].reason == "employer: excluded (Acme)" and out[4].reason == "location: Dubai, UAE is outside India" and out[5].reason == "location: Indiana is not a recognised Indian location"
    assert out[6].passed and out[6].reason == "location: Pune, India (IN-MH-PNQ) is outside IN-KA-BLR"
    assert all(out[i].passed and out[i].reason is None for i in (7, 8, 9))
    strict = pipelines.gated(refs, req, regions).withColumnRenamed("verdict", "strict").join(pipelines.gated(refs, req, regions, False).select("ref_id", F.col("verdict").alias("loose")), "ref_id").where("ref_id < 5 or ref_id = 8")
    saved = {r.ref_id: r.verdict.passed for r in gate.rescue(strict, "req_id", "strict", "loose").collect()}
    assert saved == {1: True, 2: True, 3: False, 4: False, 8: True}


def test_claims(spark):
    schema = "subject_id string, claim_type string, claim_key string, claim_value string, value_num double, tier string, source_url string, snippet string, observed_at timestamp, extractor string, extractor_version string"
    rows = [("s", "skill", "Go", "Go", 1.0, "artifact_backed", "u", "uses go", None, "e", "1"), ("s", "skill", None, "x", 1.0, "self_reported", "u", "not there", None, "e", "1"), ("s", "employer", None, "Acme", None, "self_reported", "u", " ", None, "e", "1"), ("s", "skill", "caste", "x", None, "self_reported", "u", "uses", None, "e", "1"), ("s", "skill", "q", "x", None, "rumour", "u", "uses", None, "e", "1")]
    df = spark.createDataFrame(rows, schema).withColumn("doc", F.lit("He  USES Go daily"))
    good, bad = claims.validate(df, "doc")
    assert [r.claim_key for r in good.collect()] == ["Go"]
    assert sorted(r.bucket for r in bad.collect()) == ["banned", "invalid", "invalid", "unquotable"]
    first = claims.write_claims(spark.createDataFrame([], schema), good.drop("doc"), F.lit(NOW))
    again = good.drop("doc").withColumn("tier", F.lit("self_reported")).withColumn("value_num", F.lit(5.0))
    r = claims.write_claims(first, again, F.lit(NOW)).collect()
    assert len(r) == 1 and r[0].tier == "artifact_backed" and r[0].value_num == 5.0 and r[0].observed_at == NOW
    prof = spark.createDataFrame([("s", "Dev", None, 3.5, ["Go", "SQL"], "MIT", "Pune", None, None, "u")], "subject_id string, title string, employer string, years double, skills array<string>, education string, location string, region string, open_to_work boolean, url string")
    assert sorted(r.claim_type for r in claims.person_claims(prof, F.lit(NOW)).collect()) == ["education", "experience_years", "link", "location", "skill", "skill", "title"]
    fails = spark.createDataFrame([(1, "1", "e2", 2), (1, "1", "e1", 1), (None, "1", "a", 1), (None, "1", "b", 1)], "fetch_id int, extractor_version string, error string, failed_at int")
    assert sorted(r.error for r in claims.quarantine(fails).collect()) == ["a", "b", "e1"]


def test_identity(spark):
    keys = spark.createDataFrame([("a", "k", "1"), ("b", "k", "2"), ("c", "k", "3"), ("c", "k", "2"), ("d", "k", " ")], "source_id string, kind string, value string")
    ids = spark.createDataFrame([(1, "s1", "k", "2"), (2, "s2", "k", "3")], "identity_id long, subject_id string, kind string, value string")
    assert {r.source_id: r.outcome for r in identity.resolve(keys, ids).collect()} == {"a": "create", "b": "attach", "c": "review", "d": "none"}
    c = spark.createDataFrame([(1, "s1", "skill", None, "u"), (2, "s1", "skill", "Go", "u"), (3, "s2", "skill", None, "u")], "claim_id long, subject_id string, claim_type string, claim_key string, source_url string")
    i2, c2, journal = identity.merge(ids, c, spark.createDataFrame([("s1", "s2")], "from_id string, into_id string"))
    assert {r.claim_id: r.subject_id for r in c2.collect()} == {1: "s1", 2: "s2", 3: "s2"} and {r.subject_id for r in i2.collect()} == {"s2"}
    i3, c3 = identity.unmerge(i2, c2, journal)
    assert sorted(map(tuple, c3.collect()), key=str) == sorted(map(tuple, c.collect()), key=str) and sorted(map(tuple, i3.collect())) == sorted(map(tuple, ids.collect()))


def test_layouts(spark):
    page = "Head of Ferries\nBlue Harbour · Part-time\nMar 2015 - Present · 9 yrs\nTidewater Works\n4 yrs 3 mos\nCork · On-site\nDock planner\nContract\nMay 2011 - Feb 2015 · 3 yrs\nDeck hand\nApr 2010 – Apr 2011\n- carried ropes\n2008 - 2009\nPeople also viewed\nStranger\nNowhere · Freelance\n1999 - 2001"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "2001 - 2002")], "doc int, text string")
    got = [(r.title, r.employer, r["from"], r.to) for r in layout.open_ended(layout.experience_entries(df, "doc", "text")).orderBy("pos").collect()]
    assert got == [("Head of Ferries", "Blue Harbour", "Mar 2015", None), ("Dock planner", "Tidewater Works", "May 2011", "Feb 2015"), ("Deck hand", "Tidewater Works", "Apr 2010", "Apr 2011")]
    edu = spark.createDataFrame([(1, "Institute · x\nBachelor\n2012 – 2016")], "doc int, text string")
    assert [tuple(r)[2:] for r in layout.education_entries(edu, "doc", "text").collect()] == [("Institute", "Bachelor")]
    sk = spark.createDataFrame([(1, "Skills\nPython\n3 endorsements\nSkill mapping\nClerk at Quay\nSQL\nPython")], "doc int, text string")
    assert layout.skill_lines(sk, "doc", "text").first().skills == ["Python", "Skill mapping", "SQL"]


def test_pages(spark):
    page = "<html><head><title>t</title><style>x</style></head><body><h2>Jane Doe, <b>Head of Data</b></h2><p>Acme builds</p><script>var a='<p>no</p>'</script><p>Other Jane Doe</p></body></html>"
    df = spark.createDataFrame([(1, page), (2, None)], "page int, html string").withColumn("text", html.page_text("html"))
    assert [r.text for r in df.orderBy("page").collect()] == ["Jane Doe,\nHead of Data\nAcme builds\nOther Jane Doe", ""]
    assert one(spark, t=html.title_near(F.lit("Jane Doe,\nHead of Data"), F.lit("jane doe"))).t == "Head of Data"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>x</title><body><p>Hello there</p>", "Hello there"),
        ("<span>Priya Sharma</span><span>VP Supply</span>", "Priya Sharma|VP Supply"),
        ("one<a>Jane</a>two", "one|Jane|two"),
        ("<p>a<svg><title>t</title><text>x</text></svg>b", "a|b"),
        ("<div><noscript>no</div>yes", "yes"),
        ("<head><noscript><p>x</p></noscript>y", "x|y"),
        ("a</foo>b", "ab"),
        ("a</p>b", "a|b"),
        ("a<!--c-->b<?x?>c</>d", "a|b|cd"),
        ("foo<table>bar<tr><td>x</td></tr>baz</table>q", "foobarbaz|x|q"),
        ("<table><b>x<tr><td>y</table>z", "x|y|z"),
        ("<table><caption>c<tr><td>d<td>e<table><tr><td>f</table>g</table>h", "c|d|e|f|g|h"),
        ("<p>1<b>2<p>3</b>4", "1|2|3|4"),
        ("<p><b>x</p>y</b>z", "x|y|z"),
        ("<ul><li>a<li>b<p>c</ul>d", "a|b|c|d"),
        ("<svg><circle><p>text</p></svg>more", "text|more"),
        ("<svg/>a<svg><style>p{}</style><![CDATA[zz]]></svg>b", "a|b"),
        ("<math><mi>x</mi><![CDATA[a<b]]></math>y", "x|a<b|y"),
        ("<select><option>a<option>b<div>c</select>d", "a|bc|d"),
        ("<textarea><p>x</textarea><title>y</title>", "<p>x|y"),
        ("a &lt; b &amp; c&nbsp;d < e", "a < b & c d < e"),
        ("kept <b", "kept"),
        ("x<p title='>'>y<p a=it's>z", "x|y|z"),
        ("<body>a</body>b</html>c", "abc"),
        ("<template><p>x</template>y<script>never", "y"),
        ("two\nlines", "two|lines"),
        ("<iframe><p>x</iframe><xmp><b></xmp><plaintext>a<b>", "<p>x|<b>|a<b>"),
        ("", ""),
    ],
)
def test_text_nodes(page, want):
    assert htmltree.blocks_of(page) == want.replace("|", "\n")


def test_text_nodes_of_any_page():
    import random

    rng = random.Random(4)
    parts = ["<p>", "</p>", "<b>", "</b>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<svg>", "</svg>", "<select>", "</select>", "<option>", "<li>", "</li>", "<a>", "</a>", "<template>", "</template>", "<noscript>", "</noscript>", "<head>", "</head>",
             "<caption>", "<col>", "<button>", "</button>", "<h1>", "</h2>", "<form>", "</form>", "<math>", "<mi>", "</math>", "<br>", "</br>", "<!--", "-->", "<title>", "</title>", "<div>", "</div>", "<nobr>", "<body>", "</body>", "<i>", "</i>", "x", "y z", "&amp;", "<"]
    for _ in range(4000):
        htmltree.blocks_of("".join(rng.choice(parts) for _ in range(rng.randrange(40))))
    for deep in ("<div>" * 30_000 + "x", "<p><b>x" * 10_000, "<table>x" * 2000, "<b><div>" * 3000 + "</b>" * 3000, "<a " * 50_000):
        htmltree.blocks_of(deep)


def windows_by_rule(text, name, employer, around=160):
    """Plain Python of the rule that the windows follow."""
    word = lambda s: {w.lower() for w in re.findall("[A-Za-z0-9]+", s)}
    keys = set() if word(employer) & set(constants.TITLE_CUES) else {w for w in word(employer) if len(w) >= 2} - set(constants.EMPLOYER_STOP)
    blocks, out = text.split("\n"), []
    for i, block in enumerate(blocks):
        if not name or not keys or name.lower() not in block.lower():
            continue
        after = blocks[i + 1] if i + 1 < len(blocks) else ""
        window = block if word(block) & keys else block + "\n" + after if word(after) & keys else None
        if window is None:
            continue
        if len(window) > 2 * around:
            a = window.lower().index(name.lower())
            z = a + len(name)
            lo, hi = max(0, a - around), min(len(window), z + around)
            if lo:
                space = window.find(" ", lo)
                lo = a if space < 0 or space > a else space + 1
            if hi < len(window):
                space = window.rfind(" ", z, hi)
                hi = hi if space < 0 else space
            window = window[lo:hi].strip()
        if window and window not in [w for _, w in out]:
            out.append((i, window))
    return out


def test_windows_equal_the_rule(spark):
    import random

    rng = random.Random(9)
    vocabulary = ["Priya", "Sharma", "Priya Sharma", "EY", "They", "hired", "Kestrel", "Foods", "Kestrel Foods", "and", "Ltd", "x" * 150, "(EY)", "priya sharma,", "VP"]
    texts = ["They praised Priya Sharma\nEY hired Priya Sharma", "Priya Sharma leads Kestrel\nnothing", "a " * 100 + "Priya Sharma" + " b" * 20 + " EY", "Priya Sharma" + "\n" + "y" * 400 + " EY", ""]
    texts += ["\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    people = [("Priya Sharma", "EY"), ("Priya Sharma", "Kestrel Foods Ltd"), ("Sharma, P.", "EY"), ("Priya Sharma", "Head Office"), ("", "EY"), (None, "EY"), ("Priya Sharma", None), ("priya sharma,", "ey ltd")]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], "page int, text string")
    targets = spark.createDataFrame([(i, s, n, e) for i in range(len(texts)) for s, (n, e) in enumerate(people)], "page int, subject_id int, name string, employer string")
    got = sorted((r.page, r.subject_id, r.pos, r.window) for r in html.windows(pages, "page", "text", targets).collect())
    want = sorted((i, s, pos, w) for i, t in enumerate(texts) for s, (n, e) in enumerate(people) if n and e for pos, w in windows_by_rule(t, n, e))
    assert got == want and len(want) > 200
    best = {(r.page, r.subject_id): r.pos for r in html.corroborations(pages, "page", "text", targets).collect()}
    assert best == {(i, s): min(p for a, b, p, _ in want if (a, b) == (i, s)) for i, s, *_ in want}


def test_mentions_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    names = ["ann", "ann lee", "ann lee may", "ann lee may dow", "ann lee ann ann lee", "may may ann ann lee lee", "lee", "may ann"]
    pages = [(i, "\n".join(" ".join(rng.choice(["ann", "ann", "lee", "lee", "may", "dow", "Acme", "é"]) for _ in range(rng.randrange(24))) for _ in range(5))) for i in range(60)] + [(99, None), (98, "")]
    people = [(i, n, e) for i, (n, e) in enumerate((n, e) for n in [*names, "", None, "--"] for e in ("Acme Ltd", "dow", None))]
    index = html.postings(spark.createDataFrame(pages, "page int, text string"), "page", "text")
    got = sorted(tuple(r) for r in html.mentions(index, "page", spark.createDataFrame(people, "subject_id int, name string, employer string")).select("page", "subject_id", "block", "distance").collect())
    want = []
    for p, text in pages:
        lines = [re.findall("[a-z0-9]+", b.lower()) for b in (text or "").split("\n")]
        for s, n, e in people:
            n, e = re.findall("[a-z0-9]+", n or ""), set(re.findall("[a-z0-9]+", (e or "").lower())) - {"ltd"}
            for i, line in enumerate(lines):
                if n and any(line[j : j + len(n)] == n for j in range(len(line))):
                    near = [d for d in (0, 1) if i + d < len(lines) and set(lines[i + d]) & e]
                    want += [(p, s, i, near[0])] if near else []
    assert got == sorted(want) and len(want) > 100


def test_titles(spark):
    t = lambda w, n="Ann Lee": one(spark, t=html.title_near(F.lit(w), F.lit(n))).t
    assert t("Ann Lee joined. Ann Lee - VP Supply; x") == "VP Supply"
    assert t("Ann Lee, gardener 1. ANN LEE | Head of Ops.") == "Head of Ops"
    assert t("Ann Lee (VP)") is None and t("Ann Lee, one two three four five six head") is None
    assert t("A.B (x) – Chief Officer", "A.B (x)") == "Chief Officer" and t(None) is None


def test_jobs_and_reports(spark):
    j = spark.createDataFrame([(1, "running", 3, NOW - dt.timedelta(minutes=16), None), (2, "running", 1, NOW - dt.timedelta(minutes=16), "x"), (3, "running", 1, NOW, None), (4, "queued", 0, None, None)], "id int, state string, attempts int, locked_at timestamp, last_error string")
    assert {r.id: (r.state, r.last_error) for r in jobs.reap(j, F.lit(NOW)).collect()} == {1: ("failed", "lease expired"), 2: ("queued", "x"), 3: ("running", None), 4: ("queued", None)}
    r = one(spark, a=jobs.payload_hash(F.lit("k"), F.lit('{"b":1,"a":2}')), b=jobs.payload_hash(F.lit("k"), F.lit('{"a":2, "b":1}')), c=jobs.payload_hash(F.lit("k"), F.lit('{"a":"2", "b":1}')), d=jobs.payload_hash(F.lit("l"), F.lit('{"a":2, "b":1}')), o=jobs.outcome(F.lit(503), F.lit(None).cast("string"), ["timeout"]), f=jobs.outcome(F.lit(404), F.lit("Timeout"), ["timeout"]), x=jobs.outcome(F.lit(404), F.lit("gone"), ["timeout"]))
    assert r.a == r.b and len({r.a, r.c, r.d}) == 3 and (r.o, r.f, r.x) == ("retry", "retry", "fail")
    m = spark.createDataFrame([(1, "r", "s", 0.3, True, None), (2, "r", "s", 0.5, True, NOW), (3, "q", "s", 0.1, True, NOW)], "match_id long, req_id string, subject_id string, score double, passed boolean, scored_at timestamp")
    s = spark.createDataFrame([("s", "Jane", "active")], "subject_id string, name string, status string")
    a = spark.createDataFrame([(1, 1, "shortlisted", NOW)], "action_id long, match_id long, action string, acted_at timestamp")
    c = spark.createDataFrame([("s", "skill", "Go", "Go", 1.0, "self_reported", "u")], "subject_id string, claim_type string, claim_key string, claim_value string, value_num double, tier string, source_url string")
    row = reports.shortlist(m, s, a, c, s.select("subject_id")).where("req_id = 'r'").first()
    assert (row.score, row.last_action, row.top_skills, row.bucket, row.label) == (0.5, "shortlisted", ["Go"], "ranked", "Good match")
    assert [x.action for x in reports.valid_actions(a.withColumn("action", F.lit("bogus")))[1].collect()] == ["bogus"]
    reqs = spark.createDataFrame([("r", ["t"]), ("q", ["u"])], "req_id string, titles array<string>")
    assert reports.detail(m, c, a, reqs).where("req_id = 'q'").first().prior[0].action == "shortlisted"
    assert {x.req_id for x in reports.degraded(reqs, m, c).collect()} == {"r", "q"}


def test_sources(spark, tmp_path):
    payload = '{"organic_results":[{"position":1,"title":"Jane Doe - Dev - Acme | LinkedIn","link":"https://in.linkedin.com/in/jane","snippet":"s","rich_snippet":{"top":{"extensions":["Pune, India","Dev","Acme"]}}},{"position":2,"title":"Dup","link":"https://linkedin.com/in/JANE/"},{"position":3,"title":"Co","link":"https://linkedin.com/company/x"}]}'
    refs = readers.search_refs(spark.createDataFrame([(payload,), ("{}",)], "p string"), "p").collect()
    assert [(r.ref_value, r.name, r.headline) for r in refs] == [("linkedin.com/in/jane", "Jane Doe", "Dev - Acme")]
    r = one(spark, a=readers.extensions(text.strings(["Dev", "Pune", "Acme"]), F.array(F.lit(False), F.lit(True), F.lit(False))), b=readers.extensions(text.strings(["Dev at a very long firm"]), F.array(F.lit(False))))
    assert tuple(r.a) == ("Pune", "Dev", "Acme") and tuple(r.b) == (None, "Dev at a very long firm", None)
    (tmp_path / "c.csv").write_bytes("﻿First Name,Last Name,URL,Position,Company\nJane,Doe,https://linkedin.com/in/jane,Dev,Acme\n".encode())
    assert readers.contact_refs(readers.contacts(spark, str(tmp_path / "c.csv"))).first().headline == "Dev at Acme"
    (tmp_path / "l.txt").write_text("a\n\n b \n")
    assert [x.value for x in readers.line_list(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b"]
    f = readers.with_bodies(spark.createDataFrame([("http://x?token=1", "body")], "url string, body string"))
    readers.append(f, str(tmp_path / "log"))
    readers.append(f, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_plans(spark):
    jds = spark.createDataFrame([(1, "We need Python, 5+ years, in Pune")], "jd_id int, text string")
    terms = readers.terms_frame(spark, [("Python", "language", [], [])])
    regions = spark.createDataFrame([("IN-MH-PNQ", "Pune")], "code string, place string")
    assert tuple(pipelines.draft(jds, terms, regions).first()) == (1, ["Python"], ["IN-MH-PNQ"], 5, None)
    spec = spark.createDataFrame([(["t"], ["a"], [], 3, 2, ["x"], "onsite"), (["t"], [], [], 1, 2, [], "remote"), ([], [], [], 1, 2, [], "onsite")], "titles array<string>, must_have array<string>, nice_to_have array<string>, min_years int, max_years int, regions array<string>, remote string")
    ok, blocked = pipelines.confirm(spec)
    assert [r.min_years for r in ok.collect()] == [1] and sorted(len(r.blocking) for r in blocked.collect()) == [1, 2]
    assert pipelines.corroboration_plan(spark.createDataFrame([("s", "Al", None), ("t", "", "X")], "subject_id string, name string, employer string")).first().query == '"Al" (speaker OR panelist OR keynote OR conference)'


def test_discovery_with_local_people_and_another_resolver(spark):
    req = spark.createDataFrame([("r", ["Backend Engineer"], ["Java"], [], ["IN-KA"], "hybrid"), ("q", ["Cook"], [], [], [], "remote")], "req_id string, titles array<string>, must_have array<string>, excluded_employers array<string>, regions array<string>, remote string")
    regions = spark.createDataFrame([("IN-KA", "Karnataka")], "code string, place string")
    schema = "ref_id int, req_id string, ref_kind string, ref_value string, subject_id string, title string, headline string, employer string, raw string, location string, discovered_at timestamp"
    ref = lambda i, v, title, loc=None, subject=None, req="r": (i, req, "linkedin_url", v, subject, title, None, None, None, loc, NOW)
    found = spark.createDataFrame([ref(1, "a", "Backend SDE", "Karnataka"), ref(2, "b", "Java Developer"), ref(3, "a", "Backend SDE again")], schema)
    local = spark.createDataFrame([ref(4, "b", "Java Engineer", subject="s"), ref(5, "c", "Cook")], schema)
    out = {r.ref_value: r.verdict.passed for r in pipelines.discover(spark.createDataFrame([], schema), found, req, regions, local).collect()}
    assert out == {"a": True, "b": True, "c": False}
    everywhere = lambda refs: refs.select("ref_id", F.lit("US").alias("region"))
    far = pipelines.gated(found, req, everywhere).where("ref_id = 1").first().verdict
    assert far.passed and far.reason == "location: Karnataka (US) is outside IN-KA"
    old = found.select("ref_id", F.when(F.col("ref_id") == 2, "failed").otherwise("passed").alias("state"))
    assert [(r.ref_id, r.new_state) for r in pipelines.changed(old, found.where("ref_id < 3"), req, regions).collect()] == [(2, "passed")]
    stored = found.withColumn("state", F.lit("passed")).unionByName(spark.createDataFrame([ref(9, "z", "Cook", req="q"), ref(8, "y", "Java Engineer", req="q")], schema).withColumn("state", F.lit("passed")))
    assert [r.ref_value for r in pipelines.known_elsewhere(stored, req, regions, "r").collect()] == ["y"]
    manual = found.withColumn("adapter", F.lit("manual"))
    assert pipelines.judged(manual, req, regions).count() == 0


def test_rescue_tells_its_counts(spark):
    rows = spark.createDataFrame([("r", i, i == 0, i < 3) for i in range(4)] + [(None, 9, False, True)], "req string, id int, a boolean, b boolean")
    verdict = lambda c, why: F.struct(F.col(c).alias("passed"), F.when(~F.col(c), F.lit(why)).otherwise("").alias("reason"))
    out = {r.id: r for r in gate.rescue(rows.select("req", "id", verdict("a", "title: no").alias("s"), verdict("b", "away").alias("l")), "req", "s", "l").collect()}
    assert out[1].verdict.reason == "admitted: the job-title filter refused 3 of 4 people this search found, so it is not being trusted for this role — check the headline"
    assert out[3].verdict.reason == "title: no" and not out[3].rescued and out[9].rescued


def test_merge_of_two_subjects_with_one_key(spark):
    ids = spark.createDataFrame([(1, "a", "k", "1"), (2, "b", "k", "2"), (3, "c", "k", "3")], "identity_id long, subject_id string, kind string, value string")
    c = spark.createDataFrame([(1, "a", "skill", "Go", "u"), (2, "b", "skill", "Go", "u"), (3, "b", "skill", None, "u"), (4, "a", "skill", None, "u")], "claim_id long, subject_id string, claim_type string, claim_key string, source_url string")
    i2, c2, journal = identity.merge(ids, c, spark.createDataFrame([("a", "c"), ("b", "c")], "from_id string, into_id string"))
    assert {r.claim_id: r.subject_id for r in c2.collect()} == {1: "c", 2: "b", 3: "b", 4: "c"}
    _, back = identity.unmerge(i2, c2, journal)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, c.collect()), key=str)


def test_components_are_those_allowed(spark):
    with pytest.raises(ValueError, match="age"):
        scoring.allowed_only(spark.range(1).select(*[F.lit(0.0).alias(c) for c in [*scoring.COMPONENTS, "age"]]), [])


def test_matches_upsert_by_versions(spark):
    schema = "match_id long, req_id string, subject_id string, scorer_version string, weights_version string, score double, scored_at timestamp"
    old = spark.createDataFrame([(1, "r", "s", "v2", "w1", 0.1, NOW), (2, "r", "s", "v2", "w0", 0.9, NOW)], schema)
    new = spark.createDataFrame([(3, "r", "s", "v2", "w1", 0.5, NOW + dt.timedelta(1))], schema)
    assert sorted((r.match_id, r.weights_version, r.score) for r in scoring.upsert_matches(old, new).collect()) == [(1, "w1", 0.5), (2, "w0", 0.9)]


def test_ranks_without_one_task(spark):
    import random

    r = random.Random(3)
    rows = [("r", i, round(r.choice([0.05, 0.0501, r.random()]), 6)) for i in range(900)] + [("q", 1, None), ("q", 2, 0.0)]
    df = spark.createDataFrame(rows, "req_id string, subject_id int, score double")
    got = {(x.req_id, x.subject_id): x["rank"] for x in scoring.ranked(df, "req_id").collect()}
    want = {}
    for q in "rq":
        own = sorted((x for x in rows if x[0] == q), key=lambda x: (-(x[2] if x[2] is not None else -1), x[1]))
        want |= {(q, x[1]): n for n, x in enumerate(own, 1)}
    assert got == want


def test_rolling_counts_by_hour(spark):
    import random

    r = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, r.choice(["a", None]), start + dt.timedelta(minutes=r.choice([r.randint(0, 6000), 60 * r.randint(0, 100)]))) for i in range(500)]
    got = {x.id: x.in_window for x in relational.rolling_count(spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz"), ["k"], "ts", 24, "id").collect()}
    assert got == {i: sum(k2 == k and t - dt.timedelta(hours=24) <= t2 <= t for _, k2, t2 in rows) for i, k, t in rows}


def test_from_payload_to_skills(spark):
    repo = '{"repo":{"full_name":"me/%s","html_url":"https://github.com/me/%s","fork":%s,"size":%d,"pushed_at":%s,"stargazers_count":null,"archived":%s,"owner":{"login":"%s"}},"languages":{"Go":900,"Shell":50,"Zig":100}}'
    repos = [repo % ("a", "a", "false", 5, '"2024-01-02T00:00:00Z"', "false", "me"), repo % ("b", "b", "true", 0, '"2024-01-01T00:00:00Z"', "false", "ME"), repo % ("c", "c", "true", 3, '"2024-01-01T00:00:00Z"', "false", "you"), repo % ("d", "d", "true", 3, "null", "false", "me"), repo % ("e", "e", "false", 3, "null", "true", "me")]
    payload = '{"user":{"login":"Me","type":"User","location":"Pune","hireable":true,"html_url":"https://github.com/me"},"repos":[%s]}' % ",".join(repos)
    p = spark.createDataFrame([("s", payload), ("o", payload.replace('"User"', '"Organization"'))], "subject_id string, p string")
    rows = readers.code_host_repos(p, "p")
    assert {r.repo: r.reason for r in rows.where("subject_id = 's'").select("repo", claims.usable_repo()["reason"].alias("reason")).collect()} == {"me/a": "", "me/b": "fork with no content", "me/c": "fork owned by someone else", "me/d": "fork with no commits by this user", "me/e": "archived with no stars"}
    skills, unknown = claims.language_claims(claims.capped_repos(rows), readers.terms_frame(spark, [("Golang", "language", ["go"], [])]), ["shell"], 0.05)
    got = skills.collect()
    assert [(r.claim_key, r.value_num, r.source_url, r.snippet) for r in got] == [("Golang", 900.0, "https://github.com/me/a", "Golang: 900 bytes (86% of me/a), last pushed 2024-01-02")] and [r.raw for r in unknown.collect()] == ["Zig"]
    said = claims.account_claims(readers.code_host_accounts(p, "p"), spark.createDataFrame([("IN-MH", "Pune")], "code string, place string")).collect()
    assert sorted((r.subject_id, r.claim_type, r.claim_key, r.claim_value) for r in said) == [("s", "availability", None, "hireable"), ("s", "location", "IN-MH", "Pune")]


def test_search_to_linked_refs(spark):
    payload = '{"organic_results":[{"position":1,"title":"Ann Lee - Baker | LinkedIn","link":"https://uk.linkedin.com/in/Ann-Lee/"}]}'
    refs = readers.search_refs(spark.createDataFrame([(payload,)], "p string"), "p").select("ref_value", F.lit("linkedin_url").alias("ref_kind"), F.lit(None).cast("string").alias("subject_id"))
    ids = spark.createDataFrame([("linkedin_slug", "Ann-Lee", "s1")], "kind string, value string, subject_id string")
    assert identity.link_refs(refs, ids).first().subject_id == "s1"


def test_dictionaries_and_files(spark, tmp_path):
    (tmp_path / "terms.yaml").write_text('Go: {kind: language, aliases: [Golang]}\n"C++": {kind: language}\nDjango: {kind: framework, implies: [Python]}\n')
    (tmp_path / "regions.yaml").write_text("IN-KA-BLR:\n  - Bengaluru\n  - Whitefield\nIN-KA:\n  - Karnataka\n")
    terms, regions = readers.yaml_terms(spark, str(tmp_path / "terms.yaml")), readers.yaml_regions(spark, str(tmp_path / "regions.yaml"))
    assert {(r.key, r.name) for r in dictionary.alias_lookup(terms).collect()} == {("go", "Go"), ("golang", "Go"), ("c", "C++"), ("django", "Django")}
    assert [(r.code, r.place, r.ord) for r in regions.orderBy("ord").collect()] == [("IN-KA-BLR", "Bengaluru", 0), ("IN-KA-BLR", "Whitefield", 1), ("IN-KA", "Karnataka", 2)]
    (tmp_path / "terms.json").write_text('{"ord":0,"name":"Go","kind":"language","aliases":["Golang"],"implies":["C"]}\n{"ord":1,"name":"SQL","kind":"tool"}\n')
    (tmp_path / "regions.json").write_text('{"code":"IN","places":["India"]}\n')
    assert sorted(r.alias for r in readers.term_dictionary(spark, str(tmp_path / "terms.json")).collect()) == ["Go", "Golang", "SQL"]
    assert readers.region_dictionary(spark, str(tmp_path / "regions.json")).first().place == "India"
    kinds = dictionary.kind_of(spark.createDataFrame([("Go",), ("Zig",)], "name string"), "name", terms)
    assert {r.name: r.kind for r in kinds.collect()} == {"Go": "language", "Zig": None}
    r = one(spark, a=dictionary.cities(F.lit("x"), F.create_map(F.lit("x"), F.array(F.lit("y")))), b=dictionary.cities(F.lit("z"), F.create_map(F.lit("x"), F.array(F.lit("y")))))
    assert (r.a, r.b) == (["y"], [])
    df = spark.range(3)
    readers.backup(df, str(tmp_path / "copy"))
    readers.backup(df.where("id > 0"), str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 2
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "a").write_bytes(b"x" * 700)
    (tmp_path / "cache" / "b").write_bytes(b"x" * 200)
    use = readers.folder_usage(spark, str(tmp_path / "cache"), 1000).first()
    assert (use.bytes, use.share, use.light, use.human) == (900, 0.9, "amber", "900 B")
    s = spark.createDataFrame([("Top\nAbout me\nline\nend",), ("none",)], "t string").select(layout.section(df, "t", "About me").alias("s"))
    assert [x.s for x in s.collect()] == ["About me\nline\nend", None]


def test_collect_score_and_detail(spark):
    schema = "subject_id string, claim_type string, claim_key string, claim_value string, value_num double, tier string, source_url string, snippet string, observed_at timestamp, extractor string, extractor_version string"
    prof = spark.createDataFrame([("s", "Dev", "Acme", 3.5, ["Go", "gender"], None, "Pune", "IN-MH", True, "u")], "subject_id string, title string, employer string, years double, skills array<string>, education string, location string, region string, open_to_work boolean, url string")
    stored, refused = pipelines.collect_person(spark.createDataFrame([], schema), prof, F.lit(NOW))
    assert sorted(r.claim_type for r in stored.collect()) == ["availability", "employer", "experience_years", "link", "location", "skill", "title"] and [r.bucket for r in refused.collect()] == ["banned"]
    refs = spark.createDataFrame([("r", "s"), ("r", "s"), ("r", "gone"), ("r", None)], "req_id string, subject_id string")
    people = spark.createDataFrame([("s", "active"), ("gone", "archived")], "subject_id string, status string")
    pairs = pipelines.attached(refs, people)
    assert [tuple(r) for r in pairs.collect()] == [("r", "s")]
    req = spark.createDataFrame([("r", "business", ["x"], ["Go"], [], 1, ["IN-MH"], "hybrid", 540)], REQ)
    w = spark.createDataFrame([(1, "business", "b1", True, 0.5, 0.0, 0.3, 0.0, 0.2)], "weights_id int, profile string, version string, active boolean, " + ", ".join(f"w_{c} double" for c in scoring.COMPONENTS))
    row = pipelines.score(req, stored, w, F.lit(NOW), pairs).first()
    assert row.weights_version == "b1" and row.score == 1.0 and row.passed
    m = spark.createDataFrame([(1, "r", "s", 0.3, True, NOW, "b1", {"skill_match": 1.0, "skill_depth": 0.0})], "match_id long, req_id string, subject_id string, score double, passed boolean, scored_at timestamp, weights_version string, components map<string,double>")
    ids = spark.createDataFrame([("s", "hf_user", "me"), ("s", "so_user_id", "1")], "subject_id string, kind string, value string")
    a = spark.createDataFrame([], "action_id long, match_id long, action string, acted_at timestamp")
    d = reports.detail(m, stored, a, req, ids, spark.createDataFrame([("b1", {"skill_depth": 0.0})], "version string, weights map<string,double>")).first()
    assert d.components == {"skill_match": 1.0} and [(x.kind, x.url) for x in d.links] == [("hf_user", "https://huggingface.co/me"), ("so_user_id", None)]
    labels = spark.createDataFrame([("IN-MH", "Mumbai area"), ("XX", "Nowhere")], "code string, label string")
    assert [x.code for x in panels.region_choices(spark.createDataFrame([("IN-MH", "Pune")], "code string, place string"), labels).collect()] == ["IN-MH"]


@pytest.mark.parametrize("name", ["deduplicated", "rolling_counts", "sessions"])
def test_streams(spark, name, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 2, "view", 1.0, "{}") for i in range(48)] + [(0, dt.datetime(2024, 1, 1), 0, "view", 1.0, "{}")]
    rows_schema = mirrors.SCHEMA.replace("timestamp_ntz", "timestamp")
    df = spark.createDataFrame(rows, rows_schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    later = spark.createDataFrame([(900, dt.datetime(2024, 1, 9), 7, "late", 1.0, "{}")], rows_schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for part in (df, later):  # the later row moves the watermark past all sessions of the first
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = getattr(mirrors, name)(mirrors.event_stream(spark, f"{tmp_path}/in"))
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out").where("true" if name == "sessions" else "event_type <> 'late'")
    if name == "deduplicated":
        assert out.count() == 48
    elif name == "rolling_counts":
        full = {(r.start, r.n) for r in out.collect()}
        assert (dt.datetime(2024, 1, 1), 25) in full
    else:
        assert sorted((r.user_id, r.n) for r in out.collect()) == [(0, 25), (1, 24)]


def test_regions_drop_covered_takes_every_customer(spark):
    from attesta.plans import text_queries

    d = "/root/testdata/sf0.001"
    region = {r.r_regionkey: r.r_name for r in spark.read.parquet(f"{d}/region.parquet").collect()}
    nation = {r.n_nationkey: (region[r.n_regionkey], r.n_name) for r in spark.read.parquet(f"{d}/nation.parquet").collect()}
    codes = {}
    for r in spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey").collect():
        x, y = nation[r.c_nationkey]
        codes.setdefault(r.c_custkey % 100, set()).update((x, f"{x}-{y}"))
    want = {k: {c for c in v if not any(e != c and e.startswith(c) for e in v)} for k, v in codes.items()}
    got = text_queries.QUERIES["regions_drop_covered"][0](spark, d).collect()
    assert {r.k: set(r.codes.split("|")) for r in got} == want and len(got) == len(want)


def test_quotable_containment_of_short_passages(spark):
    import inspect

    from attesta.plans import text_queries

    words = "the old mill stands by a quiet river near town".split()
    passages = [" ".join(words[i : i + n]) for n in range(1, 10) for i in range(len(words) - n + 1)] + ["", "Old  Mill", "no such words", "ill stan"]
    texts = ["(The old mill stands by a quiet river near town.)", "xthe old mill stands", "by a\nquiet river, near", "stands", "", None, "a quiet", "mill stands by a quiet rivers"]
    t = {"benchmark": spark.createDataFrame(list(enumerate(passages)), "item_id long, text string"), "documents": spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")}
    squeezed = lambda x: " ".join(x.split()).lower()
    want = {i: sum(squeezed(p) in squeezed(x) for p in passages if p) for i, x in enumerate(texts) if x is not None}
    f = inspect.getclosurevars(text_queries.QUERIES["quotable_containment"][0]).nonlocals["f"]
    assert {r.doc_id: r.n for r in f(t).collect()} == {i: n for i, n in want.items() if n}
