"""Personal data, fill-in-middle and the prefix trie against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import infilling, pii, prefixtrie

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]


def by_contract(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [s for _, _, s in sorted(found)]


AWKWARD = [
    None, "", "@", "a@b", "a@b.c@d.e", "a@@b.c x@y..z q@r.s.", "1.2.3.4.5.6.7.8 1.2.3.4", "1.2.3 .4 999.1.1.1 0001.2.3.4", "4111 1111 1111 1111", "4111-1111 1111-1111 5", "1 2 3",
    "+1 (988) 555-2485 4111111111111111", "++1 234 567 89 0", "+12", "+1-2", "é@x.y ünder+1 555 123 4567", "a.b%c@x-y.z-" * 30, "0" * 12, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
]


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_are_the_contracts(seed):
    rng = random.Random(seed)
    texts = AWKWARD + ["".join(rng.choice("a1@.+- (9é%") for _ in range(rng.randrange(60))) for _ in range(2000)]
    for t in texts:
        assert [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.base_spans(t or "")] == by_contract(t), t


def test_searches_are_linear():
    for t in ("x" * 400_000, "9" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "1 " * 200_000, "(at) " * 100_000, "A" * 400_000):
        pii.candidates(t)  # quadratic ones would take minutes


def planted(rng, n):
    """Texts with personal data that no base pattern finds, look-alikes, and (start, end) of the former."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    luhn = lambda d: d + next(c for c in "0123456789" if pii.luhn(d + c))
    card = lambda: luhn("4" + "".join(rng.choice("0123456789") for _ in range(14)))
    wrong = lambda: (lambda c: c[:-1] + str((int(c[-1]) + 1) % 10))(card())
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    make = [
        lambda: (phone(), " " + card(), True), lambda: ("", f"{phone()} ", True), lambda: ("", card() + " ", True), lambda: ("", wrong() + " ", False), lambda: ("mail me: ", f"{word()} (at) {word()} (dot) com", True),
        lambda: ("call ", f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", True), lambda: ("my name is ", f"{rng.choice(['Anna', 'Peter', 'Maria'])} {word().title()}", True),
        lambda: ("order ", wrong(), False), lambda: ("iban ", "DE89370400440532013000", True), lambda: ("iban ", "DE88370400440532013000", False), lambda: ("version ", "1.2.3.4.5", False),
    ]
    out = []
    for i in range(n):
        lead = " ".join(word() for _ in range(rng.randrange(3, 30))) + " "
        before, hit, good = rng.choice(make)()
        text = lead + before + hit
        at = len(lead + before)
        out.append((i, text + " " + word() + " " + card()[:rng.choice([0, 0, 16])], (at + len(hit) - len(hit.lstrip()), at + len(hit.rstrip())), good))
    return out


def test_added_spans_on_held_out_texts(spark):
    rows = planted(random.Random(7), 900)
    taught, held = rows[:600], rows[600:]
    frame = lambda r: spark.createDataFrame([(i, t) for i, t, _, _ in r], "doc_id long, text string")
    model = pii.fit(pii.found(frame(taught)))
    got = {r.doc_id: [(s.start, s.end, s.base) for s in r.found] for r in pii.judged(pii.found(frame(held)), model).collect()}
    hit = [good for i, _, span, good in held if any(a < span[1] and span[0] < b and (good or not base) for a, b, base in got[i])]  # base spans stay, right or wrong
    assert sum(hit) >= 0.95 * sum(good for *_, good in held)
    assert len(hit) - sum(hit) <= 0.01 * len(held)
    assert model.reliability["card", "shape"] > 0.5


def test_expectation_maximisation_finds_reliabilities():
    rng = np.random.default_rng(3)
    n, kind = 20_000, 3
    true = rng.random(n) < 0.6
    right = np.array([0.9, 0.99, 0.8, 0.7, 0.6, 0.95, 0.75, 0.85])
    v = np.where(rng.random((n, 8)) < right, 2 * true[:, None] - 1, 1 - 2 * true[:, None])
    v[:, 1] = np.where(true, 1, 0)  # nothing is refuted
    codes = collections.Counter(pii.code_of(kind, tuple(x), 1, 1) for x in v.tolist())
    keys = np.array(sorted(codes))
    p, share, table = pii.expect(keys, np.array([codes[k] for k in keys.tolist()], float))
    assert abs(share[kind] - 0.6) < 0.03
    for j in (0, 2, 3, 4, 5, 6, 7):
        assert abs(table[1, kind, j, 2] - right[j]) < 0.06 and abs(table[0, kind, j, 0] - right[j]) < 0.06
    by = dict(zip(keys.tolist(), p.tolist(), strict=True))
    assert np.mean([(by[pii.code_of(kind, tuple(x), 1, 1)] > 0.5) == t for x, t in zip(v.tolist(), true.tolist(), strict=True)]) > 0.97


def test_patterns_round_trip():
    rng = random.Random(1)
    every = [(rng.randrange(6), tuple(rng.randrange(-1, 2) for _ in range(8)), rng.randrange(4), rng.randrange(3)) for _ in range(500)]
    codes = np.array([pii.code_of(*x) for x in every])
    assert codes.max() < pii.PATTERNS
    k, v, length, digits = pii.decode(codes)
    assert [(int(a), tuple(b), int(c), int(d)) for a, b, c, d in zip(k, v.tolist(), length, digits, strict=True)] == every


def test_op11_on_awkward_rows(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "mail a.b@c.de now"), (3, "a@b"), (99, "x" * 200_000 + " a@b.cd " + "1.1.1.1 " * 2000)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("found", "kind", "spans", "start")}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.op11_pii(spark, str(tmp_path)).collect())
    want = []
    for i, t in rows:
        s = by_contract(t)
        want.append((i, *(sum(x.startswith(k) for x in s) for k in BASE), sha(",".join(s).encode())))
    assert got == collections.Counter(want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pii.op11_pii(spark, f"{tmp_path}/none").collect() == []
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cleaned = pii.scrub(docs, pii.fit(pii.found(docs)))
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert {r.text for r in cleaned.where("doc_id IS NULL").collect()} == {"mail [EMAIL] now"}


def test_found_where_runs_were_too_long(spark):
    text = "call +1 (988) 555-2485 4111111111111111 now"
    assert by_contract(text) == []
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.judged(pii.found(docs), pii.fit(pii.found(docs))).first().found
    assert [(s.kind, text[s.start : s.end], s.base) for s in got] == [("phone", "+1 (988) 555-2485", False), ("card", "4111111111111111", False)]


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def infill(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}".encode())
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \t\n\x0b\x85  aé中😀<PSM>") for _ in range(rng.randrange(40))) for _ in range(600)]
    texts += [None, "", " ", "a", "<P>", "<S> x <M", "< <P >", "\x1c a", "x y " * 60_000, "é" * 70_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c"), (None, None), (7, "again and again"), (-12, "minus twelve")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "form": F.lit("x"), "output": F.lit(None)}).repartition(3)
    got = infilling.infill(docs).withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == collections.Counter(infill(*r) for r in rows)
    assert collections.Counter((r.doc_id, r.back) for r in got) == collections.Counter((i, t or "") for i, t in rows)
    assert infilling.infill(docs.limit(0)).collect() == []


@pytest.mark.parametrize("size", [0, 1, 7, 8, 511, 512, 513, 5000])
@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_rank_and_select(size, share):
    bits = np.random.default_rng(size).random(size) < share
    b = infilling.Bits(bits)
    assert b.ones == bits.sum()
    assert b.rank(np.arange(size + 1)).tolist() == [int(bits[:i].sum()) for i in range(size + 1)]
    assert b.select(np.arange(1, b.ones + 1)).tolist() == np.flatnonzero(bits).tolist()


def trie_of(paths):
    """Nodes of {conv_id: tuple of (role, text)} by brute force."""
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = collections.defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in kids[k])
    ends = lambda k: sha(",".join(str(c) for c in sorted(members[k]) if paths[c] == k).encode())
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], ends(k)) for k, m in members.items())


def nodes(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def path_frame(spark, paths):
    turns = spark.createDataFrame([(c, d, r, t) for c, p in paths.items() for d, (r, t) in enumerate(p)] or [(0, 0, "", "")], "conv_id long, turn int, role string, text string").where(F.lit(bool(any(paths.values()))))
    hexes = turns.withColumn("b", prefixtrie.turn_bytes(F.col("role"), F.col("text"))).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "b"))), lambda x: x["b"]).alias("b"))
    ids = spark.createDataFrame([(c,) for c in paths], "conv_id long")
    return ids.join(hexes, "conv_id", "left").select("conv_id", F.coalesce(F.unhex(F.array_join("b", "")), F.lit(b"")).alias("path"))


@pytest.mark.parametrize("shape", ["random", "copies", "chain", "one turn", "empty ones"])
def test_trie_equals_brute_force(spark, shape):
    rng = random.Random(shape)
    turn = lambda n: ("user", f"word {rng.randrange(n)} of turn")
    make = {
        "random": lambda i: tuple(turn(2) for _ in range(rng.randrange(7))), "copies": lambda i: (("a", "x y"),) * 3 if i % 3 else tuple(turn(3) for _ in range(3)),
        "chain": lambda i: (("a", "x"),) * i, "one turn": lambda i: (("u", "the same"), turn(500)), "empty ones": lambda i: () if i % 2 else (turn(2),),
    }[shape]
    paths = {i * 7 - 100: make(i) for i in range(60 if shape == "chain" else 400)}
    want = trie_of(paths)
    frame = path_frame(spark, paths).repartition(5)
    assert nodes(prefixtrie.trie(frame)) == want
    assert nodes(prefixtrie.trie(frame, part_bytes=500, run_bytes=300)) == want  # many runs, many ranges, borders within paths


def test_loser_tree_merges_and_compares_no_shared_turn(monkeypatch):
    rng = random.Random(2)
    w = prefixtrie.WIDTH
    turn = lambda n: bytes([rng.randrange(n)]) * w
    runs, every = [], []
    for _ in range(13):
        paths = sorted({b"".join(turn(2) for _ in range(rng.randrange(9))) for _ in range(40)})
        run = prefixtrie.Run()
        for i, p in enumerate(paths):
            run.add(p, prefixtrie.shared(paths[i - 1], p) if i else 0, 1, i)
        every += paths
        runs.append((run.lcp, run.size, b"".join(run.rest), run.n, run.least))
    seen = []
    real = prefixtrie.shared
    monkeypatch.setattr(prefixtrie, "shared", lambda a, b, at=0: seen.append(real(a, b, at) - at) or seen[-1] + at)
    got = list(prefixtrie.merged(runs))
    assert [g[0] for g in got] == sorted(every)
    assert [g[1] for g in got] == [real(a, b) for a, b in zip([b"", *sorted(every)], sorted(every), strict=False)]
    assert sum(seen) < len(every) * 9  # a merge that compares from the start needs a multiple
    assert list(prefixtrie.merged([])) == []


def test_op13_rebuilds_conversations(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 130), 400, 405, -40, -45, -60]:
        if c in (20, 60):
            continue  # absent donors
        rows += [(c, rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(["user", None, "assistant"]), rng.choice(["a b", "c", None, "", "\t x \n y z"])) for _ in range(rng.randrange(1, 6))]
    rows += [(None, 1, "user", "nobody's"), (5, 1, "user", "twice"), (5, 1, "user", "twice")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({c: F.lit("z") for c in ("path", "donor", "own", "n")})
    frame.repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    digest = lambda r, t: sha(f"{len(r)}:{r}{t}".encode())[:32]
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c > 0 else -1)
        paths[c] = tuple(own.get(donor, [])[:h] + mine[h:])
    assert nodes(prefixtrie.op13_prefix_trie(spark, str(tmp_path))) == trie_of(paths)


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert prefixtrie.op13_prefix_trie(spark, str(tmp_path)).collect() == []


def test_ids_of_a_large_group_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 200)
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(b"a")).otherwise(F.encode(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")), "UTF-8")).alias("key"), (F.col("id") * 3 - 700).alias("conv_id")).repartition(6)
    want = collections.defaultdict(list)
    for r in rows.collect():
        want[bytes(r.key)].append(r.conv_id)
    got = {bytes(r.key): r.ends_sha256 for r in prefixtrie.joined_ids(rows).collect()}
    assert got == {k: sha(",".join(map(str, sorted(v))).encode()) for k, v in want.items()}
