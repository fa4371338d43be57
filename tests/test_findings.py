"""Faults that a review found, each on the smallest input that showed it."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from attesta.functions import scores
from test_engine import NOW, evaluate


def test_halves_round_as_in_sql(spark):
    """F1: without a must-have, scores are multiples of 5e-8; a half of the last digit is often no double."""
    got = evaluate(spark, [("skill", "Rust", None, 1.0, "artifact_backed", NOW - dt.timedelta(days=164)), ("experience_years", None, None, 0.1, "self_reported", None)], min_years=2)
    assert (got.seniority_fit, got.activity_recency) == (0.525, 0.73239)
    assert got.score == duckdb.execute("SELECT round((0.2 * 0.525 + 0.2 * 0.73239)::DOUBLE * 0.25::DOUBLE, 6)").fetchall()[0][0] == 0.062869
    x = [k * 5e-8 for k in range(0, 4_000_000, 37)]
    found = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").select("i", scores.rounded(F.col("v")).alias("x")).orderBy("i").collect()]
    assert found == [r[0] for r in duckdb.execute("SELECT round(k::DOUBLE * 5e-8::DOUBLE, 6) FROM range(0, 4000000, 37) t(k) ORDER BY k").fetchall()]


def test_pages_reach_python_in_short_batches(spark, tmp_path):
    """a worker held up to 10,000 pages at once, whatever their length."""
    from attesta.operators import html
    from attesta.plans import catalogue

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.range(1000).selectExpr("id AS page_id", "'<p>' || id || '</p>' AS html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("page_text", "page_classifier", "co_mentions"):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert catalogue.QUERIES[name][0](spark, str(tmp_path)).count() in (0, 1000)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= html.BATCH_ROWS == 256
    got = catalogue.QUERIES["page_text"][0](spark, str(tmp_path))
    assert sorted(r.text for r in got.collect()) == sorted(str(i) for i in range(1000))


def test_pages_of_customers_are_read_by_many_tasks(spark):
    """customers are a small file, read by one task, and so their pages were."""
    from attesta.plans import operator_queries
    from attesta.sources.readers import tables

    p, _ = operator_queries._pages(tables(spark, "/root/testdata/sf0.1"))
    sizes = [r["count"] for r in p.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * 15000 / len(sizes)
    plan = operator_queries.QUERIES["corroborated"][0](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(c_custkey" in plan.split("ArrowEvalPython")[-1]


def test_notes_are_sorted_as_they_are_cut(spark):
    """F8: a task sorted all notes, whole ones, beside their times."""
    from attesta.operators import jobs

    long = "x" * 500
    rows = [(1, "a", 1), (1, "b", 2), (1, "c", 2), (2, long + "a", 5), (2, long + "b", 5), (3, None, 4), (3, "old", 3), (4, "undated", None), (5, "undated", None), (5, "dated", 0), (None, "z", 9)]
    notes = spark.createDataFrame(rows, "id int, note string, noted_at int")
    df = jobs.noted(spark.range(7).selectExpr("CAST(id AS int) AS id"), notes)
    assert {r.id: r.note for r in df.collect()} == {0: None, 1: "c", 2: long, 3: None, 4: "undated", 5: "dated", 6: None}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "max(noted_at" in plan


def test_skill_lines_of_texts_are_shuffled_once(spark):
    """each line was a row, and went through two shuffles."""
    from attesta.operators import layout

    rows = [(1, "Go\nSQL\nGo"), (1, "SQL\nAda\nC"), (2, "Skills\n3 endorsements"), (None, " C \r\nAda\rpeople ALSO viewed\nGo"), (3, None), (4, "")]
    df = layout.skill_lines(spark.createDataFrame(rows, "doc int, text string"), "doc", "text")
    assert {r.doc: r.skills for r in df.collect()} == {1: ["Go", "SQL", "Ada", "C"], None: ["C", "Ada"]}
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Generate" not in plan and plan.count("Exchange") == 1


def test_scoring_sorts_no_claims(spark):
    """unions of intervals read claims twice and sorted them, as did the facts of a subject."""
    from attesta.functions import text
    from attesta.functions.constants import BANNED
    from attesta.operators import relational
    from attesta.plans import matching_queries

    day = lambda n: dt.date(1969, 10, 1) + dt.timedelta(days=n)
    rows = [("a", day(0), day(64)), ("a", day(63), day(65)), ("a", day(200), day(900)), ("b", day(5), day(5)), ("c", day(3), None), ("d", None, day(9)), (None, day(1), day(2)), ("e", day(1), day(9)), ("e", day(4), None)]
    rows += [(f"w{i}", day(i), day(i + n)) for i, n in zip(range(130), [1, 63, 64, 65, 128] * 26)]
    df = relational.union_years(spark.createDataFrame(rows, "k string, a date, b date"), "k", "a", "b")
    want = {"a": 765, "b": 0, "c": None, None: 1, "e": 8} | {f"w{i}": n for i, n in zip(range(130), [1, 63, 64, 65, 128] * 26)}
    assert {r.k: r.days for r in df.collect()} == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    parts = matching_queries.component_breakdown(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    facts = [line for line in parts.splitlines() if "experience_years" in line and "Aggregate(" in line]
    assert facts and all("ObjectHashAggregate" not in line and "SortAggregate" not in line for line in facts)
    said = spark.createDataFrame([("College-Tier 1", None), ("tier", "my DOB"), ("agent", "photon"), (None, None), ("", "age_name tokens")], "k string, v string")
    assert [r.b for r in said.select(text.banned_signal("k", "v", BANNED).alias("b")).collect()] == ["college_tier", "dob", None, None, "age"]


def _beside_sql(spark, tmp_path, names, pages):
    """Rows of the queries and of their SQL on pages made for the test."""
    from attesta.plans import catalogue

    head = "<!DOCTYPE html><html><head><title>x</title></head><body>"
    made = [(i, "http://a.example.com/", None if x is None else head + x) for i, x in enumerate(pages)]
    spark.createDataFrame(made, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in names:
        f, sql = catalogue.QUERIES[name]
        df, want = f(spark, str(tmp_path)), db.execute(sql)
        at = [[d[0] for d in want.description].index(c) for c in df.columns]
        yield sorted(map(tuple, df.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_windows_hold_references_that_titles_are_cut_after(spark, tmp_path):
    """the SQL left a quotation mark as it was where a title was cut before its semicolon."""
    pages = [f"<h1>{t}</h1><p>one two three four five six harbour crane</p>" for t in ("one two three four five six harbour crane = &quot", "one two three four five six harbour crane &amp;quot; x", "one two three four five six harbour crane &am")]
    ((got, want),) = _beside_sql(spark, tmp_path, ["block_proximity"], pages)
    assert got == want
    assert {r[2] for r in got if r[1] == 0} == {'one two three four five six harbour crane = "', "one two three four five six harbour crane &quot; x", "one two three four five six harbour crane &am"}


def test_page_text_equals_its_sql_on_odd_pages(spark, tmp_path):
    """the SQL left a reference without its semicolon, decoded others twice, and knew fewer line ends and white space."""
    pages = ["<p>token = &quot</p><p>&amp;quot; &amp;copy; &copy &middot &amp &am &amp;amp;</p>", "<p>a\r\nb\rc\u00a0 \u2003d\u3000</p>\x0b", None, ""]
    ((got, want),) = _beside_sql(spark, tmp_path, ["page_text"], pages)
    assert got == want
    assert [r[1] for r in got] == ['token = "\n&quot; &copy; \u00a9 \u00b7 & &am &amp;', "a\nb\nc d", "", ""]


def test_mentions_shuffle_no_words(spark):
    """nearly every word of the pages was a row, and went through two shuffles and a sort."""
    from attesta.operators import html
    from attesta.operators.dictionary import bit_filter, bits_hold

    long = "an old harbour crane of the north pier"
    lines = ["ann " * 300 + "acme", f"-- {long}, so they say", "at Acme.", long[:-1], "Acme", "lee", "dow acme", f"x{long} acme"]
    people = [(1, "Ann ann ann ann ann ann ann", "Acme"), (2, long.title(), "Acme Ltd"), (3, "Lee", "Dow"), (4, "Ann", "Dow"), (5, long, "Head of Acme")]
    pages = spark.createDataFrame([(i, "\n".join(lines)) for i in range(3)] + [(7, "\n".join(["word " * 50] * 20)), (8, None), (9, "")], "page int, text string")
    df = html.mentions(html.postings(pages, "page", "text"), "page", spark.createDataFrame(people, "subject_id int, name string, employer string"))
    assert sorted(map(tuple, df.select("page", "subject_id", "block", "distance").collect())) == [(i, *r) for i in range(3) for r in ((1, 0, 0), (2, 1, 1), (3, 5, 1))]
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "place" not in plan and "getbit" in plan
    hashes = spark.range(6000).selectExpr("id", "xxhash64(id) AS h")
    held = hashes.withColumn("held", bits_hold(bit_filter(hashes.where("id < 2000"), "h"), F.col("h"))).groupBy((F.col("id") < 2000).alias("made")).agg(F.count_if("held").alias("n")).collect()
    assert {r.made: r.n for r in held} == {True: 2000, False: 0}
