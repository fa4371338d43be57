"""The ten queries themselves, against their contracts in plain Python, on a corpus with awkward rows."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import queries

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
CLASH = ["score", "ids", "first", "n", "content", "row", "start", "path", "error", "size"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The smallest tables with nulls, empty and long texts, repeated rows and columns of clashing names."""
    folder = str(tmp_path_factory.mktemp("sf"))
    clash = lambda df: df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH) if c not in df.columns])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = "A very long text, token=abcdef123456 and deadbeefdeadbeefdeadbeef01. " * 3000 + "x" * 3000
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, " \t\n", "en", None, 3), (-4, long, "en", "s", 1), (-5, long + " end", "en", "s", 1)], docs.schema)
    clash(docs.unionByName(extra).unionByName(docs.orderBy("doc_id").limit(3))).repartition(3).write.parquet(f"{folder}/documents.parquet")
    for t in ("embeddings", "pages", "conversations", "labels"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "embeddings":
            df = df.unionByName(spark.createDataFrame([(50_000, None), (50_050, [])], df.select("vec_id", "embedding").schema), allowMissingColumns=True)
        if t == "pages":
            df = df.unionByName(df.limit(2).select("page_id", "url", F.lit(None).cast("string").alias("html")), allowMissingColumns=True)
        if t == "conversations":
            df = df.unionByName(spark.createDataFrame([(9_000, 0, "user", None), (9_000, 1, "assistant", "</s><|end|>")], df.select("conv_id", "turn", "role", "text").schema), allowMissingColumns=True)
        clash(df).write.parquet(f"{folder}/{t}.parquet")
    return folder


def rows(spark, corpus, name, fields):
    return sorted((tuple(r[f] for f in fields) for r in queries.QUERIES[name](spark, corpus).collect()), key=str)


def documents(spark, corpus):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{corpus}/documents.parquet").select("doc_id", "text").collect()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_op1(spark, corpus):
    import tiktoken

    from attesta.llm.bpe import load_ranks

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in documents(spark, corpus):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert rows(spark, corpus, "op1_byte_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(want, key=str)


def test_op2(spark, corpus):
    got = rows(spark, corpus, "op2_toxicity", ["doc_id", "held_out", "score", "predicted"])
    docs = documents(spark, corpus)
    assert collections.Counter(r[0] for r in got) == collections.Counter(i for i, _ in docs)
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 3 == 1) and 0 <= r[2] <= 1 and r[3] == (r[2] >= 0.7) for r in got)


def test_op3(spark, corpus):
    vecs = [(r.vec_id, np.floor(256 * np.array(r.embedding, float)).astype(np.int64)) for r in spark.read.parquet(f"{corpus}/embeddings.parquet").collect() if r.embedding]
    want = []
    for i, v in vecs:
        if i % 50 == 0:
            top = sorted((-int(v @ w), j) for j, w in vecs if j != i and len(w) == len(v))[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(top, 1)]
    assert rows(spark, corpus, "op3_top_k", ["query_id", "rank", "vec_id", "score"]) == sorted(want, key=str)


def test_op4(spark, corpus):
    docs, sets, parent = documents(spark, corpus), [], {}
    for _, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        sets.append(frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) if w else frozenset())

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(zip([i for i, _ in docs], sets, strict=True), 2):
        if s and t and 100 * len(s & t) >= 90 * len(s | t):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = [(i, len(s), find(i)) for (i, _), s in zip(docs, sets, strict=True)]
    assert rows(spark, corpus, "op4_ngram_jaccard", ["doc_id", "n_shingles", "component_id"]) == sorted(want, key=str)


def test_op5(spark, corpus):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = []
    for i, t in documents(spark, corpus):
        t = t or ""
        found = [(0, m.start(), m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        found += [(1, m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(2, m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[1], x[0])))
        want.append((i, *(sum(x[0] == k for x in found) for k in range(3)), sha(text.encode())))
    assert rows(spark, corpus, "op5_secret_scans", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]) == sorted(want, key=str)


def test_op6(spark, corpus):
    docs = documents(spark, corpus)
    got = queries.QUERIES["op6_best_fit_packing"](spark, corpus).collect()
    size = collections.Counter()
    for r in got:
        size[r.doc_id] += r.n_bytes
    assert size == sum((collections.Counter({i: len((t or "").encode())}) for i, t in docs), collections.Counter()) | collections.Counter({i: 0 for i in size if not size[i]})
    assert {i for i, _ in docs} == {r.doc_id for r in got}


def test_op7(spark, corpus):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{corpus}/pages.parquet").collect()]
    first = {}
    for i, b in pages:
        first[b] = min(first.get(b, i), i)
    again = lambda i, b: len(b) >= 100 and first[b] != i
    want = [(i, len(b), sha(b), "revisit" if again(i, b) else "response", first[b] if again(i, b) else None) for i, b in pages]
    assert rows(spark, corpus, "op7_warc", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]) == sorted(want, key=str)


def test_op8(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sorted(queries.QUERIES["op8_token_files"](spark, corpus).collect(), key=lambda r: (r.doc_id, r.start))
    ids = collections.defaultdict(list)
    for i, t in documents(spark, corpus):
        x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        ids[i].append((len(x), zlib.crc32(x.tobytes())))
    at = 0
    for r in got:
        assert r.start == at
        ids[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not any(ids.values())


def test_op9(spark, corpus):
    turns = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{corpus}/conversations.parquet").collect()]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = []
    for c, own in itertools.groupby(sorted(turns), key=lambda x: x[0]):
        own = list(own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        want.append((c, len(own), sha("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()), len(loss), sha(loss.encode())))
    assert rows(spark, corpus, "op9_chat_format", ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]) == sorted(want, key=str)


def test_op10(spark, corpus):
    want = []
    for i, t in documents(spark, corpus):
        raw = (t or "").encode()
        pay = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(pay), sha(pay), zlib.crc32(pay[-64:])))
    got = rows(spark, corpus, "op10_media_columns", ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"])
    assert got == sorted(want, key=str)
    by = collections.defaultdict(set)
    text = dict(documents(spark, corpus))
    for r in queries.QUERIES["op10_media_columns"](spark, corpus).collect():
        by[text[r.doc_id]].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, corpus, name):
    """The queries that have SQL, on the tables with awkward rows."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{corpus}/{t}.parquet/*.parquet')")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert rows(spark, corpus, name, names) == sorted((tuple(r) for r in want.fetchall()), key=str)
    assert sorted(names) == sorted(queries.QUERIES[name](spark, corpus).columns)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (name == "op9_chat_format")
