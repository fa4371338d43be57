"""Stores that grow by batches, adapters, prefix joins and leases as a stream."""

import datetime as dt
import glob
import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from attesta.operators import claims, dictionary, jobs, relational, store
from attesta.sources import adapters, readers
from attesta.streaming import leases

T0 = dt.datetime(2024, 1, 1)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/refs"
    old = spark.range(500).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("old").alias("v"), F.col("id").alias("first"), F.lit(0).alias("at"))
    store.create(old, path, ["k"], buckets=16)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/refs/*/*.parquet")}
    new = spark.createDataFrame([(3, "new", 1003, 2), (3, "mid", 1004, 1), (None, "null", 9, 1), (9999, "added", 7, 1)], "k long, v string, first long, at int")
    touched = store.merge(path, new, ["k"], ["at"], ["v", "at"], buckets=16)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/refs/*/*.parquet")}
    assert 1 <= len(touched) <= 3
    bucket = lambda f: int(f.split("_bucket=")[1].split("/")[0])
    assert {f for f in before if bucket(f) not in touched} == {f for f in after if bucket(f) not in touched and after[f] == before[f]}
    want = relational.upsert(old, new, ["k"], ["at"], ["v", "at"])
    key = lambda r: (r.k or -1, r.v, r.first, r["at"])
    got = store.stored(spark, path)
    assert sorted(map(key, got.select(want.columns).collect())) == sorted(map(key, want.collect())) and got.count() == 501
    assert store.merge(path, new.where("false"), ["k"], ["at"], ["v"], buckets=16) == []


def test_ids_of_batches_at_one_time(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    got: dict[int, list[int]] = {}

    def add(n: int) -> None:
        out = store.append(spark.range(n * 700).repartition(3).select(F.lit(n).alias("batch_no"), F.col("id").alias("row")), path, "fetch_id", block=256)
        got[n] = [r.fetch_id for r in out.collect()]

    threads = [threading.Thread(target=add, args=(n,)) for n in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    ids = [i for v in got.values() for i in v]
    assert sorted(map(len, got.values())) == [700, 1400, 2100] and len(set(ids)) == 4200
    all_rows = store.log(spark, path)
    assert all_rows.count() == 4200 and all_rows.select("fetch_id").distinct().count() == 4200
    assert store.append(spark.range(0).select(F.col("id").alias("row")), path, "fetch_id").count() == 0


def test_bodies_are_kept_once(spark, tmp_path):
    path = f"file://{tmp_path}/bodies"
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "body string").withColumn("digest", F.sha2("body", 256))
    assert store.keep_bodies(frame(["a", "b", "a", None]), path).count() == 2
    assert store.keep_bodies(frame(["b", "c"]), path).count() == 1
    batches = [threading.Thread(target=store.keep_bodies, args=(frame(["d", "e", f"own {i}"]), path)) for i in range(2)]
    [t.start() for t in batches]
    [t.join() for t in batches]
    assert sorted(r.body for r in store.bodies(spark, path).collect()) == ["a", "b", "c", "d", "e", "own 0", "own 1"]
    assert store.keep_bodies(frame(["a", "e"]), path).count() == 0


def test_adapters_equal_the_parsers(spark, tmp_path):
    search = [{"organic_results": [{"position": i, "title": f"P {i} - Head - Acme | LinkedIn", "link": f"https://www.linkedin.com/in/p{i}" if i % 2 else "https://x.y", "snippet": "s"} for i in range(4)]}, {}]
    code = [{"subject_id": 7, "user": {"login": "me", "type": "User"}, "repos": [{"repo": {"full_name": "me/a", "size": 3, "pushed_at": "2024-01-01T00:00:00Z"}, "languages": {"Go": 5}}]}, {"subject_id": 8, "user": {"login": "x"}}]
    for name, payloads in (("search", search), ("code_host", code)):
        os.makedirs(f"{tmp_path}/{name}")
        for i, p in enumerate(payloads):
            with open(f"{tmp_path}/{name}/{i}.json", "w") as f:
                f.write(json.dumps(p) + "\n")
    texts = spark.createDataFrame([(p.get("subject_id"), json.dumps(p)) for p in search + code], "subject_id long, payload string")
    key = lambda rows: sorted(str(r.asDict(True)) for r in rows)
    repos = adapters.read(spark, "code_host", f"{tmp_path}/code_host")
    assert key(repos.collect()) == key(readers.code_host_repos(texts.where("subject_id IS NOT NULL"), "payload").collect()) and repos.count() == 1
    refs = adapters.read(spark, "search", f"{tmp_path}/search")
    want = readers.search_refs(texts.where("subject_id IS NULL"), "payload").select(refs.columns)
    assert key(refs.collect()) == key(want.collect()) and refs.count() == 2
    one = adapters.read(spark, "code_host", f"{tmp_path}/code_host", F.col("subject_id") == 8).select("login")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(subject_id), EqualTo(subject_id,8)" in plan and "stargazers" not in plan
    for name, batch in (("code_host", repos), ("search", refs)):
        q = adapters.stream(spark, name, f"{tmp_path}/{name}", files_at_once=1).writeStream.format("memory").queryName(f"adapter_{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert key(spark.table(f"adapter_{name}").collect()) == key(batch.collect())
    jobs_ = spark.createDataFrame([(1, "search", json.dumps(search[0])), (2, "fax", "{}"), (3, None, None), (4, "search", "not json")], "id int, kind string, payload string")
    by, unknown = adapters.handled(jobs_)
    assert by["search"].count() == 2 and by["code_host"].count() == 0 and sorted(r.id for r in unknown.collect()) == [2, 3]
    with pytest.raises(KeyError):
        adapters.adapter("fax")
    with pytest.raises(ValueError):
        adapters.register(adapters.REGISTRY["search"])


def test_prefix_joins(spark):
    rng = random.Random(1)
    code = lambda: "".join(rng.choice("AB-") for _ in range(rng.randrange(0, 6)))
    a, b = [(i, code()) for i in range(120)] + [(500, None)], [(i, code()) for i in range(90)] + [(501, None)]
    left, right = spark.createDataFrame(a, "i int, x string"), spark.createDataFrame(b, "j int, y string")
    pairs = dictionary.prefix_pairs(left, "x", right, "y")
    want = sorted((i, j) for i, x in a for j, y in b if x and y and (x.startswith(y) or y.startswith(x)))
    assert sorted((r.i, r.j) for r in pairs.collect()) == want
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    best = {r.i: r.y for r in dictionary.longest_prefix(left, "i", "x", right, "y").collect()}
    assert best == {i: max((y for _, y in b if x and y and x.startswith(y)), key=len, default=None) for i, x in a}


def test_small_rules(spark):
    a = spark.createDataFrame([("k1", 1), ("k2", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("k2", 9, "x"), ("k3", 8, "y"), (None, 7, "z")], "k string, v int, w string")
    got = {r.k: (r.v, r.w) for r in relational.union_by_precedence([a, b], ["k"], [F.asc("v")]).collect()}
    assert got == {"k1": (1, None), "k2": (2, None), None: (3, None), "k3": (8, "y")}
    rows = spark.createDataFrame([("k", 1, None), ("k", 2, False), ("k", 3, True)], "k string, i int, f boolean")
    assert [r.i for r in relational.flagged_first(rows, ["k"], F.col("f"), [F.desc("i")]).orderBy("place").collect()] == [3, 2, 1]
    roles = spark.createDataFrame([("r",), ("s",)], "req_id string")
    refs = spark.createDataFrame([("r", "passed"), ("r", "rejected"), ("r", "passed"), (None, "passed")], "req_id string, gate_state string")
    done = spark.createDataFrame([("r", "done", T0), ("r", "queued", None)], "req_id string, state string, finished_at timestamp")
    assert {r.req_id: tuple(r)[1:] for r in jobs.ruled_out(roles, refs, done).collect()} == {"r": (2, 1, 2, T0), "s": (0, 0, 0, None)}
    ev = spark.createDataFrame([("p", 1), ("p", 1), ("p", 2), ("q", None)], "subject_id string, fetch_id int")
    fetched = spark.createDataFrame([(1, "web", "a.gz"), (2, "other", "b.gz"), (3, "web", "c.gz")], "fetch_id int, adapter string, body_path string")
    assert [tuple(r) for r in claims.evidence_bodies(ev, fetched, "web").collect()] == [("p", "a.gz")]


def test_leases_over_a_restart_equal_the_batch(spark, tmp_path):
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    first = [(1, "queued", minute(0)), (1, "claimed", minute(1)), (2, "queued", minute(0)), (3, "queued", minute(0)), (3, "claimed", minute(1)), (3, "done", minute(5)), (4, "claimed", minute(2)), (4, "claimed", minute(3))]
    second = [(1, "claimed", minute(30)), (4, "claimed", minute(31)), (5, "queued", minute(40)), (5, "claimed", minute(41)), (6, "queued", minute(59)), (99, "queued", minute(60))]
    out, at = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    known = spark.createDataFrame([(7, "running", 3, minute(-5)), (8, "done", 1, minute(-5))], "job_id long, state string, attempts int, since timestamp")

    def run(rows, n):
        spark.createDataFrame(rows, "job_id long, event string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        events = spark.readStream.schema("job_id long, event string, at timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        with leases.rocksdb(spark):
            q = leases.lease_events(events, known).writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out)
            q.awaitTermination()

    os.makedirs(f"{tmp_path}/in")
    before = spark.conf.get(leases._PROVIDER)
    run(first, 1)
    run(second, 2)
    assert spark.conf.get(leases._PROVIDER) == before
    got = sorted((r.job_id, r.what, r.state, r.attempts, r["at"]) for r in spark.read.parquet(out).collect())
    stall = dt.timedelta(seconds=90)
    assert got == sorted([
        (1, "lease expired", "queued", 1, minute(16)), (1, "lease expired", "queued", 2, minute(45)), (2, "stalled", "queued", 0, minute(0) + stall), (4, "lease expired", "queued", 2, minute(18)),
        (4, "lease expired", "failed", 3, minute(46)), (5, "lease expired", "queued", 1, minute(56)), (7, "lease expired", "failed", 3, minute(10)),
    ])
    # the batch rule at the stream's clock finds the leases that are out then
    table = spark.createDataFrame([(1, "running", 2, minute(30), None), (4, "running", 3, minute(31), None), (5, "running", 1, minute(41), None)], "id int, state string, attempts int, locked_at timestamp, last_error string")
    reaped = {r.id: (r.state, r.attempts) for r in jobs.reap(table, F.lit(minute(59))).collect()}
    last = {}
    for job, what, state, attempts, when in sorted(got, key=lambda x: x[4]):
        if what == "lease expired":
            last[job] = (state, attempts)
    assert reaped == {k: last[k] for k in reaped}
