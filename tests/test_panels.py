"""Panels, targets, routing and classifiers."""

import datetime as dt

from pyspark.sql import functions as F

from attesta.operators import panels


def test_panels(spark):
    refs = spark.createDataFrame([("r", f"u{i}", "passed") for i in range(5)] + [("r", "v", "failed")], "req_id string, ref_value string, state string")
    ref = lambda *x: spark.createDataFrame([(v,) for v in x], "ref_value string")
    assert tuple(panels.collection_panel(refs, ref("u0"), ref("u0", "u1"), F.lit(2)).first()) == ("r", 3, 1, 1, 2)
    kept, missed = panels.named_only(refs, ref("u1", "zz"), "ref_value")
    assert [r.ref_value for r in kept.collect()] == ["u1"] and [r.ref_value for r in missed.collect()] == ["zz"]
    c = spark.createDataFrame([(1, "s", "employer", "Old", "self_reported", None), (2, "s", "employer", "New", "self_reported", dt.datetime(2024, 1, 1)), (3, "s", "employer", "Third", "third_party_stated", dt.datetime(2025, 1, 1))], "claim_id int, subject_id string, claim_type string, claim_value string, tier string, observed_at timestamp")
    assert panels.current_employer(c).first().employer == "New"
    people = spark.createDataFrame([("a", "Jane", "Acme Ltd", 1), ("b", "", "Acme", 2), ("c", "Jo", "Ltd", 3), ("d", "Al", "Senior Engineer", 4), ("e", "Ed", "Beta", 5)], "subject_id string, name string, employer string, rank int")
    done = spark.createDataFrame([("e",)], "subject_id string")
    assert [r.subject_id for r in panels.corroboration_targets(people, done, ["ltd"], ["engineer"]).collect()] == ["a"]
    contacts = spark.createDataFrame([(f"u{i}", "Data engineer") for i in range(4)] + [("x", "Cook")], "ref_value string, headline string")
    assert [(r.req_id, r.ref_value) for r in panels.assign_contacts(contacts, {"d": ["data"], "o": ["ops"]}, 3).orderBy("place").collect()] == [("d", "u0"), ("d", "u1"), ("d", "u2")]
    lines = spark.createDataFrame([("c", 1, "Website", "https://x.y"), ("c", 2, "Company size", "11-50 employees"), ("c", 3, "Industry", "Tools"), ("c", 4, "x", "1999"), ("c", 5, "x", "2001"), ("c", 6, "y", "z")], "company string, pos int, label string, value string")
    assert panels.overview_fields(lines).first().fields == {"website": "https://x.y", "size": "11-50 employees", "industry": "Tools", "founded": "1999"}
    r = spark.range(1).select(panels.link_url(F.lit("github_login"), F.lit("me")).alias("a"), panels.link_url(F.lit("phone"), F.lit("1")).alias("b"), panels.find_more(F.lit(False), F.lit(3), 3).alias("c"), panels.wall_marker(F.lit("Please SIGN IN to see it")).alias("d"), panels.stage_name(F.lit("enrich")).alias("e")).first()
    assert tuple(r) == ("https://github.com/me", None, "deepest", "Sign in to see", "Reading profiles")


def test_page_classifier_reads_whole_texts(spark):
    long = "word " * 1100
    cases = [  # text, rendered, walled, experience, dated ranges
        (None, False, False, False, 0),
        ("", False, False, False, 0),
        ("Jan 2019 - Present", False, False, False, 1),
        ("JANUARY. 2019–mar 2021, Sept 2020 — Present", False, False, False, 2),
        ("2016 - Present", False, False, False, 0),
        ("AUTHWALL", False, True, False, 0),
        (long, True, False, False, 0),
        (long + "Sign in to See", False, True, False, 0),
        (long + "Experience Feb 2020 - Mar 2021 " * 3, True, False, True, 3),
        ("x" * 5000, False, False, False, 0),
        ("😀" * 5001, True, False, False, 0),
        ("MyJan 2019 - Present", False, False, False, 0),
        ("Jan\u00a02019 - Present", False, False, False, 1),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string")
    got = {r[0]: tuple(r)[1:] for r in df.select("i", *panels.page_fields(F.col("text"))).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
