"""Scans, ranks and dictionary lookups against plain Python, with one key that holds all rows."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.operators import dictionary, relational, scan, scoring

START = dt.datetime(2024, 1, 1)


def rows_of(keys, n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(keys), START + dt.timedelta(seconds=rng.randrange(0, 40 * 3600, 7)), rng.choice([None, None, f"v{i}"])) for i in range(n)]


KEYS = [["a"], ["a", None], ["a", "a", "a", "b", "c", None]]


@pytest.mark.parametrize("keys", KEYS)
def test_throttle_equals_the_fold(spark, keys):
    rows = rows_of(keys, 800, 1)
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp, v string")
    out = relational.throttled(df, ["k"], "ts", 300, "id")
    assert out.columns == [*df.columns, "starts_at"]
    want, free = {}, {}
    for i, k, ts, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = max(ts, free[k] + dt.timedelta(seconds=300)) if k in free else ts
        free[k] = want[i]
    assert {r.id: r.starts_at for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_cell" in plan and "Window" in plan


@pytest.mark.parametrize("keys", KEYS)
def test_carry_forward_and_stale_pages_equal_the_fold(spark, keys, monkeypatch):
    monkeypatch.setattr(relational, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(i, rng.choice(keys), i // 2, rng.choice([None, None, None, f"v{i}"])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, k string, at int, v string")
    got = {r.id: r.carried for r in relational.carry_forward(df, ["k"], ["at", "id"], F.col("v"), "carried").collect()}
    last, want = {}, {}
    for i, k, _, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[i] = last[k]
    assert got == want
    pages = [(k, p, rng.randrange(400)) for k in {str(k) for k in keys} for p in range(120) for _ in range(4)]
    got = {(r.k, r.p): r.new_items for r in relational.pages_until_stale(spark.createDataFrame(pages, "k string, p int, item int"), "k", "p", "item").collect()}
    want = {}
    for k in {str(k) for k in keys}:
        seen = set()
        for p in range(120):
            items = {i for kk, pp, i in pages if (kk, pp) == (k, p)}
            if not items - seen:
                break
            want[k, p] = len([1 for i in items - seen])
            seen |= items
    assert set(got) == set(want)


@pytest.mark.parametrize("keys", KEYS)
def test_interval_union_equals_the_days(spark, keys):
    rng = random.Random(5)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    rows = [(k, day(a), day(a + rng.choice([0, 1, 30, 900]))) for k in keys for a in (rng.randrange(6000) for _ in range(60))]
    got = {r.k: (r.days, r.years) for r in relational.union_years(spark.createDataFrame(rows, "k string, a date, b date"), "k", "a", "b").collect()}
    for k in set(keys):
        days = len({a + dt.timedelta(days=i) for kk, a, b in rows if kk == k for i in range((b - a).days)})
        assert got[k] == (days, int(days / 365.25 * 10) / 10)


def test_a_key_of_all_rows_is_in_many_cells(spark):
    df = spark.range(4000).select(F.lit("one").alias("k"), (F.col("id") % 50).cast("double").alias("x"), "id")
    cut = scan.quantile_cells(df.withColumn("x", F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.col("x"))), F.col("x"), scan.position(df, "id"), 16)
    sizes = [r["count"] for r in cut.groupBy("_at").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 700  # two thirds of all rows have one value


@pytest.mark.parametrize("scores", ["many", "few", "one", "none"])
def test_ranks(spark, scores):
    rng = random.Random(7)
    value = {"many": lambda: rng.random(), "few": lambda: rng.choice([0.0, 0.0, 0.5]), "one": lambda: 0.0, "none": lambda: None}[scores]
    rows = [(rng.choice(["r", "r", "r", "s", None]), i * 37 % 1001, value()) for i in range(900)]
    df = spark.createDataFrame(rows, "req_id string, subject_id int, score double")
    got = {(r.req_id, r.subject_id): r["rank"] for r in scoring.ranked(df, "req_id").collect()}
    want = {}
    for k in ("r", "s", None):
        for n, (_, s) in enumerate(sorted((-(float("-inf") if x is None else x), s) for q, s, x in rows if q == k), 1):
            want[k, s] = n
    assert got == want
    assert scoring.ranked(df.where("false"), "req_id").collect() == []
    named = df.select("req_id", F.concat(F.lit("person number "), F.col("subject_id").cast("string")).alias("subject_id"), "score")
    got = [(r.subject_id) for r in scoring.ranked(named.where("req_id = 'r'"), "req_id").orderBy("rank").collect()]
    assert got == [s for _, s in sorted((-(float("-inf") if x is None else x), f"person number {s}") for q, s, x in rows if q == "r")]


def test_scores_are_read_once(spark):
    from attesta.plans import matching_queries

    df = matching_queries.shortlist_scored(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "lineitem" not in plan  # what is ranked are written scores
    parts = matching_queries.component_breakdown(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in parts and "NestedLoop" not in parts


def terms_of(spark, n):
    """A dictionary of n names, two aliases each; the first are common words."""
    rng = random.Random(1)
    names = ["the", "of and", "is"] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 12))) + rng.choice(["", " x", " y z"]) for _ in range(n)]
    return spark.createDataFrame([(f"T{i % n}", a, i) for i, a in enumerate(names)], "name string, alias string, ord int")


def test_dictionaries_of_any_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    small, large = terms_of(spark, 3), terms_of(spark, 100_000)
    took = {}
    for name, terms in (("small", small), ("large", large), ("small", small), ("large", large)):
        began = time.time()
        dictionary.terms_in_text(docs, "doc_id", "text", terms).write.format("noop").mode("overwrite").save()
        took[name] = time.time() - began
    assert took["large"] < 2 * took["small"] + 3  # the dictionary itself is parsed in that time too
    dim = {r.key: r.name for r in dictionary.alias_lookup(large).collect()}
    got = {r.doc_id: r.names for r in dictionary.terms_in_text(docs, "doc_id", "text", large).collect()}
    for r in docs.limit(200).collect():
        w = [re.sub("[+#.]", "", x).lower() for x in re.split("[^A-Za-z0-9+#.]+", r.text or "") if x]
        found = [dim[k] for n in (3, 2, 1) for i in range(len(w) - n + 1) if (k := "".join(w[i : i + n])) in dim]
        assert got.get(r.doc_id, []) == list(dict.fromkeys(found))


def test_lookup_of_places_that_numbers_once_mixed(spark):
    """Stage and place are two fields: a place of any size stays in its stage."""
    r = spark.range(1).select(text.window_keys(F.lit("A b. #c")).alias("w")).first().w
    assert [(x.stage, x.place, x.key) for x in r] == [(0, 0, "abc"), (1, 0, "ab"), (1, 1, "bc"), (2, 0, "a"), (2, 1, "b"), (2, 2, "c")]
    regions = spark.createDataFrame([("IN", "India"), ("IN-KA", "Karnataka"), ("IN-KA-BLR", "New Bengaluru")], "code string, place string")
    df = spark.createDataFrame([(1, "we moved to new Bengaluru, in India"), (2, "India"), (3, "nowhere"), (4, None), (5, "+ new + bengaluru")], "id int, t string")
    assert {r.id: r.region for r in dictionary.region_of(df, "id", "t", regions).collect()} == {1: "IN-KA-BLR", 2: "IN", 3: None, 4: None, 5: "IN-KA-BLR"}
    assert {r.id: sorted(r.codes) for r in dictionary.regions_in_text(df, "id", "t", regions).collect()} == {1: ["IN-KA-BLR"], 2: ["IN"], 5: ["IN-KA-BLR"]}
    none = spark.createDataFrame([], "code string, place string")
    assert dictionary.regions_in_text(df, "id", "t", none).collect() == []
