"""N-gram Jaccard join: prefix filters under several token orders, intersected before sets are compared; links and components.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets link when den * |A and B| >=
num * |A or B|. With p = n - ceil(n * num / den) + 1, they then share l tokens among the first p + l - 1 of each, under
*every* global token order and for every l up to p. The steps:

1. Equal sets (by a 128-bit digest) fold to the one of least id, salted; the rest deals with distinct sets only.
2. Order 1 (a hash), l = p / 2: tokens of those prefixes are counted by partial aggregation, and a set drops out unless
   l of its own are in another set's prefix as well; twice over, as others that dropped out no longer count. Accidental
   and common passages don't keep a set. A task sends the prefix of copies that it meets again but once.
3. The texts that are left are fetched. Order 2 is by exact frequency among them, rare tokens first, l = 1: a token of
   one set only uses up prefix places without being dealt at all. Tokens left are dealt by token and size class (classes
   are so wide that linked sets lie in the same or neighbouring ones, and each set posts in two cells).
4. Sets that share a cell are candidates. First each cell's sets pair with one leader, another in each cell; verified
   links make components. Then the sets of a cell pair across components only: within one a further link changes nothing.
   So a group of near copies takes at most as many pairs a member as its prefix has tokens.
5. Of candidates a sketch is fetched first (parities of 1,024 cells, whose differences bound the symmetric difference
   from below), then the prefixes under orders 3 and 4 (further hashes). What differs too much, or shares no token under
   one of the orders, goes. Only for what all orders let pass are the whole sets fetched and compared.
6. Links are counted apart, by a pivot: the set with the most known links of its component. With d the symmetric
   difference to the pivot, f = (den - num) * n - (num + den) * d: by the triangle inequality sets A and B link if
   f(A) + f(B) >= 0. So all sets with f >= 0 (the core) link with each other and need no comparison. The others are
   compared with all of their component, in cells of two blocks, which give counts and not pairs.

Edge cases: null, empty and blank texts have empty sets, link with nothing and are their own component; texts of
fewer words than a shingle are one shingle; texts of any length are taken whole; rows that repeat a doc_id share a
component (that of all their sets), but each has the links of its own set; null doc_ids link with nothing and have a
null component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lookup, short_batches, table, with_first, written
from .components import components

PARITY = 1024  #: bits of a set's parity sketch
BLOCK, BLOCK_TOKENS = 512, 250_000  #: sets, and tokens of all sets, in a block of a component (on average)
SEEN = 50_000  #: sets that a task remembers, so that it sends a copy's prefix but once
WORDS_KEPT = 50_000  #: word hashes that a worker keeps
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_words = _Words()


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; words are runs without ASCII white space, A-Z folded."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > WORDS_KEPT:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    acc = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        acc = mix(acc * np.uint64(0x100000001B3) ^ h[j : j + len(acc)])
    return np.unique(acc)


def need(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - need(n, num, den) + 1 if n else 0


def prefix(s: np.ndarray, order: int, size: int) -> np.ndarray:
    """The first tokens of a set under a global order (a hash)."""
    return s[np.argsort(mix(s, order), kind="stable")[:size]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(xs: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(np.concatenate(xs) if xs else np.zeros(0, np.uint64)))


def _bytes(col: pa.Array) -> list[bytes | None]:
    return col.cast(pa.binary()).to_pylist()


def shared_least(n: int, num: int, den: int) -> int:
    """l of order 1."""
    return (prefix_size(n, num, den) + 1) // 2


def _signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, least, fp1, fp2, prefix) under order 1; the prefix is empty where the task has sent it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            sets = [shingles(x, k) for x in _bytes(b.column(1))]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            fp = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            n = [len(s) for s in sets]
            least = [shared_least(need(x, num, den), num, den) for x in n]  # that of the smallest set that it may link with
            sent = []
            for s, d in zip(sets, digests, strict=True):
                sent.append(s[:0] if d in seen else prefix(s, 1, prefix_size(len(s), num, den) + shared_least(len(s), num, den) - 1))
                seen.add(d)
            if len(seen) > SEEN:
                seen.clear()
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(least, pa.int64()), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), _lists(sent)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "least", "fp1", "fp2", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, least long, fp1 long, fp2 long, prefix array<long>")


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, set, parity, prefix3, prefix4); the prefixes hold 32 bits of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x, k) for x in _bytes(b.column(1))]
            parity = [np.packbits((np.bincount((s >> np.uint64(12)).astype(np.int64) & (PARITY - 1), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64) for s in sets]
            cols = [pa.array([np.sort(prefix(s, order, prefix_size(len(s), num, den)).astype(np.uint32)).tobytes() for s in sets], pa.binary()) for order in (3, 4)]
            head = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(parity, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*head, *cols], ["doc_id", "n", "set", "parity", "prefix3", "prefix4"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set binary, parity array<long>, prefix3 binary, prefix4 binary")


def _tokens(sets: DataFrame) -> DataFrame:
    """(t, doc_id): a row for each token of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, s in zip(b.column(0), b.column(1), strict=True):
                t = np.frombuffer(s.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(t), doc_id.as_py()))], ["t", "doc_id"])

    return sets.select("doc_id", "set").mapInArrow(run, "t long, doc_id long")


def _shared(postings: DataFrame, owner: str = "doc_id") -> DataFrame:
    """Postings whose token has two owners or more."""
    several = postings.groupBy("t").agg(F.min(owner).alias("x"), F.max(owner).alias("y")).where("x <> y").select("t")
    return postings.join(several, "t", "left_semi")


def _size_cells(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Postings (t, doc_id, n) by token and size class: linked sets share a cell."""
    width = math.log(den / num) * (1 + 1e-9)
    c = F.floor(F.log(F.col("n").cast("double")) / width)
    return postings.select(F.explode(F.array(F.xxhash64("t", c), F.xxhash64("t", c + 1))).alias("t"), "doc_id", "n")


def _most(num: int, den: int) -> str:
    """The greatest symmetric difference of two linked sets x and y."""
    total = "(x.n + y.n)"
    return f"({total} - 2 * (({num} * {total} + {num + den - 1}) div {num + den}))"


def _size_allows(num: int, den: int) -> str:
    return f"{den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n)"


def _sketch_allows(num: int, den: int) -> str:
    return f"aggregate(zip_with(x.parity, y.parity, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d) <= {_most(num, den)}"


def _surviving(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that share tokens under orders 3 and 4 as well and whose sketches allow a link. No set is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for r in zip(*(b.column(c) for c in ("p3", "q3", "p4", "q4")), strict=True):
                p3, q3, p4, q4 = (np.frombuffer(x.as_buffer(), np.uint32) for x in r)
                keep.append(bool(np.isin(p3, q3, assume_unique=True).any() and np.isin(p4, q4, assume_unique=True).any()))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda v, out, cols: sets.select(F.col("doc_id").alias(v), F.struct(*cols).alias(out))
    both = lambda df, cols: lookup(lookup(df, side("a", "x", cols), "a", "b"), side("b", "y", cols), "b", "a")
    close = written(both(pairs, ("n", "parity")).where(_sketch_allows(num, den)).select("a", "b"), "close")
    out = both(close, ("prefix3", "prefix4")).select("a", "b", F.col("x.prefix3").alias("p3"), F.col("y.prefix3").alias("q3"), F.col("x.prefix4").alias("p4"), F.col("y.prefix4").alias("q4"))
    out = written(out.mapInArrow(run, "a long, b long"), "passed")
    discard(close)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, both): the pairs that link by their whole sets, and how many tokens they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared, keep = [], []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared.append(len(np.intersect1d(p, q, assume_unique=True)))
                keep.append(den * shared[-1] >= num * (len(p) + len(q) - shared[-1]))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(shared, pa.int64())], ["a", "b", "both"]).filter(pa.array(keep, pa.bool_()))

    side = lambda v, s: sets.select(F.col("doc_id").alias(v), F.col("set").alias(s))
    return lookup(lookup(pairs, side("a", "sa"), "a", "b"), side("b", "sb"), "b", "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, both long")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """Links among candidate pairs (a, b): filters first, whole sets for what passes."""
    pairs = written(pairs, f"{name}_pairs")
    passed = _surviving(pairs, sets, num, den)
    links = written(_verified(passed, sets, num, den), f"{name}_links")
    discard(pairs, passed)
    return links


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|A and B| of each set of ``left`` with each of ``right``."""
    _, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = sum(map(len, left))
    mine, theirs, size = at[:cut], at[cut:], int(at.max()) + 1
    rows, cols = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right))
    df = np.bincount(theirs, minlength=size)
    dense = df > max(8, len(right) // 8)  # these by a product of matrices, the others by lists
    place = np.cumsum(dense) - 1
    x, y = (np.zeros((len(v), int(dense.sum())), np.float32) for v in (left, right))
    x[rows[dense[mine]], place[mine[dense[mine]]]] = 1
    y[cols[dense[theirs]], place[theirs[dense[theirs]]]] = 1
    both = np.rint(x @ y.T).astype(np.int64)
    owners = cols[np.argsort(theirs, kind="stable")]
    start = np.cumsum(df) - df
    few = np.where(dense, 0, df)
    bounds = np.cumsum([0, *map(len, left)])
    for i in range(len(left)):
        t = mine[bounds[i] : bounds[i + 1]]
        n = few[t]
        if total := int(n.sum()):
            both[i] += np.bincount(owners[np.repeat(start[t] - (np.cumsum(n) - n), n) + np.arange(total)], minlength=len(right))
    return both


def _link_counts(classes: DataFrame, folded: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(first, set_links, row_links): with how many other sets each linked set links, and how many rows have those."""

    def count(cell: pa.Table) -> pa.Table:
        x = [np.frombuffer(s.as_buffer(), np.uint64) for s in cell["set"]]
        ids, copies, block, core = (cell[c].to_numpy() for c in ("first", "copies", "block", "core"))
        n = np.array([len(s) for s in x])
        u, v, with_core = cell["u"][0].as_py(), cell["v"][0].as_py(), cell["with_core"][0].as_py()
        i, j = np.flatnonzero(~core & (block == u)), np.flatnonzero((core == with_core) & (block == v))
        found = np.zeros((len(x), 2), np.int64)
        if len(i) and len(j):
            both = _common([x[k] for k in i], [x[k] for k in j])
            ok = den * both >= num * (n[i][:, None] + n[j][None, :] - both)
            if u == v and not with_core:
                np.fill_diagonal(ok, False)
            else:
                found[j] = np.stack([ok.sum(0), copies[i] @ ok], 1)
            found[i] = np.stack([ok.sum(1), ok @ copies[j]], 1)
        return pa.table({"first": ids, "set_links": found[:, 0].copy(), "row_links": found[:, 1].copy()})

    degree = links.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count("*").alias("degree"))
    members = written(folded.where("doc_id = first").select("first", "n", "copies").distinct().join(classes, "first").join(degree, "first"), "members")
    pivots = members.groupBy("component").agg(F.max(F.struct("degree", F.xxhash64("first").alias("h"), F.col("first").alias("pivot"), F.col("n").alias("pn"))).alias("p")).select("p.pivot", "p.pn")
    ends = links.select(F.col("a").alias("pivot"), F.col("b").alias("first"), "both").unionByName(links.select(F.col("b").alias("pivot"), F.col("a").alias("first"), "both"))
    to_pivot = lookup(ends, pivots, "pivot", "first").where("pn IS NOT NULL").select("first", (F.col("pn") - 2 * F.col("both")).alias("more"))
    own = pivots.select(F.col("pivot").alias("first"), (-F.col("pn")).alias("more"))
    f = (den - num) * F.col("n") - (num + den) * (F.col("n") + F.col("more"))
    placed = members.join(to_pivot.unionByName(own), "first", "left").withColumn("core", F.coalesce(f >= 0, F.lit(False))).select("first", "component", "n", "copies", "core")
    placed = written(placed, "placed")
    inner = lambda c: F.sum(F.when(F.col("core"), c).otherwise(0))
    outer = lambda c: F.sum(F.when(F.col("core"), 0).otherwise(c))
    one = F.lit(1)
    sizes = placed.groupBy("component").agg(inner(one).alias("cores"), inner(F.col("copies")).alias("core_copies"), inner(F.col("n")).alias("core_tokens"), outer(one).alias("others"), outer(F.col("n")).alias("other_tokens"), F.sum("copies").alias("held"))
    placed = written(lookup(placed, sizes, "component", "first"), "sized")
    two = placed.where("cores + others = 2").select("first", F.lit(1).cast("long").alias("set_links"), (F.col("held") - F.col("copies")).alias("row_links"))
    many = placed.where("cores + others > 2")
    known = many.where("core").select("first", (F.col("cores") - 1).alias("set_links"), (F.col("core_copies") - F.col("copies")).alias("row_links"))
    blocks = lambda rows, tokens: F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(tokens) / BLOCK_TOKENS)).cast("long")
    open_ = many.where("others > 0").select("first", "component", "copies", "core", blocks("cores", "core_tokens").alias("cb"), blocks("others", "other_tokens").alias("ob"))
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("first", F.lit(5)), F.when(F.col("core"), F.col("cb")).otherwise(F.col("ob"))))
    # a core block meets every block of the others; a block of the others meets those and all core blocks
    to = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    cell = lambda u, v, core: F.struct(u.alias("u"), v.alias("v"), F.lit(core).alias("with_core"))
    none = F.expr("CAST(array() AS array<struct<u:bigint,v:bigint,with_core:boolean>>)")
    cells = F.when(F.col("core"), F.transform(to("ob"), lambda o: cell(o, F.col("block"), True))).otherwise(
        F.concat(F.transform(to("ob"), lambda o: cell(F.least(F.col("block"), o), F.greatest(F.col("block"), o), False)), F.when(F.col("cb") > 0, F.transform(to("cb"), lambda c: cell(F.col("block"), c, True))).otherwise(none))
    )
    whole = open_.join(sets.select(F.col("doc_id").alias("first"), "set"), "first").withColumn("cell", F.explode(cells)).select("first", "copies", "set", "block", "core", "component", "cell.*")
    found = whole.groupBy("component", "u", "v", "with_core").applyInArrow(count, "first long, set_links long, row_links long")
    out = written(two.unionByName(known).unionByName(found).groupBy("first").agg(F.sum("set_links").alias("set_links"), F.sum("row_links").alias("row_links")), "counts")
    discard(members, placed)
    return out


def row_key() -> Column:
    """Tells the texts of a repeated doc_id apart; null without doc_id."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))


def _repeated(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``join`` where rows of one doc_id have different sets: joined by key, then components meet by doc_id."""
    keyed = docs.select(row_key().alias("key"), "doc_id", "text")
    got = written(join(keyed.select(F.col("key").alias("doc_id"), "text"), k, num, den).withColumnRenamed("doc_id", "key"), "keyed")
    ids = keyed.select("key", "doc_id").distinct()
    rows = written(lookup(got.where("key IS NOT NULL").withColumn("_row", F.monotonically_increasing_id()), ids, "key", "_row").drop("_row", "key"), "rows")
    ends = rows.groupBy("doc_id").agg(F.min("component_id").alias("a"))
    same = components(rows.select("doc_id", F.col("component_id").alias("b")).distinct().join(ends, "doc_id").select("a", "b"))
    placed = lookup(rows, same.withColumnRenamed("id", "component_id"), "component_id", "doc_id").withColumn("group", F.coalesce("component", "component_id"))
    out = with_first(placed.withColumnRenamed("copies", "rows"), ["group"], "doc_id").select("doc_id", "n_shingles", F.col("first").alias("component_id"), F.col("rows").alias("copies"), "set_links", "n_links")
    return out.unionByName(got.where("key IS NULL").withColumnRenamed("key", "doc_id"))


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, copies, set_links, n_links) of each document.

    ``copies`` counts the rows with the same set, itself included; ``set_links`` the other sets that its set links with;
    ``n_links`` the other rows that it links with, those of the same set included.
    """
    spark = docs.sparkSession
    short_batches(spark)
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1MB")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(_signatures(docs, k, num, den), "signatures")
    some = F.expr("n > 0 AND doc_id IS NOT NULL")
    folded = written(with_first(rows.where(some).select("doc_id", "n", "least", "fp1", "fp2"), ["fp1", "fp2"], "doc_id"), "folded")
    if not folded.groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("fp1", "fp2") for f in (F.min, F.max))).where("min_fp1 <> max_fp1 OR min_fp2 <> max_fp2").isEmpty():
        discard(rows, folded)
        return _repeated(docs, k, num, den)
    owner = F.xxhash64("fp1", "fp2").alias("owner")
    reps = folded.where("doc_id = first").select("doc_id", owner, "least").distinct()
    tokens = rows.where(some).select(F.explode("prefix").alias("t"), owner)
    kept = []
    for turn in (1, 2):
        tokens = written(_shared(tokens, "owner"), f"tokens{turn}")
        kept.append(tokens)
        enough = tokens.groupBy("owner").agg(F.count("*").alias("c")).join(reps, "owner").where("c >= least").select("owner")
        tokens = tokens.join(enough, "owner", "left_semi")
    alive = written(_shared(tokens, "owner").select("owner").distinct().join(reps, "owner").select("doc_id").distinct(), "wanted")  # Spark broadcasts it only if its files are small
    rest = written(rows.where(~F.coalesce(some, F.lit(False))).select("doc_id", "n"), "rest")
    discard(rows, *kept)
    # the comparison holds for all; with one, Spark takes the side for selective and, where it is of at most
    # spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold, filters the texts by its Bloom filter before the shuffle
    alive_ids = alive.where(F.col("doc_id") >= F.lit(-(1 << 63)))
    sets = written(_sets(docs.join(alive_ids, "doc_id", "left_semi"), k, num, den), "sets")
    discard(alive)

    if not sets.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows that repeat a document
        sets, twice = written(sets.dropDuplicates(["doc_id"]), "sets"), sets
        discard(twice)

    every = _tokens(sets)
    common = written(every.groupBy("t").agg(F.count("*").alias("df")).where("df > 1").select("t", F.least(F.col("df"), F.lit(1 << 30)).cast("int").alias("df")), "common")
    ranked = every.join(common, "t").select("t", "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "t")).alias("place"), F.count("*").over(Window.partitionBy("doc_id")).alias("held"))
    facts = sets.select("doc_id", "n", "parity")
    length = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    first = ranked.join(facts.select("doc_id", "n"), "doc_id").where(F.col("place") <= length - (F.col("n") - F.col("held"))).select("t", "doc_id", "n")
    first = written(first, "first")
    discard(common)
    postings = written(_shared(_size_cells(first, num, den)).distinct(), "postings")
    discard(first)

    rank = F.struct(F.xxhash64("doc_id", "t").alias("h"), "doc_id", "n")
    lead = postings.groupBy("t").agg(F.min(rank).alias("m")).select("t", "m.doc_id", "m.n")
    ordered = lambda df: df.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    stars = lead.alias("x").join(postings.alias("y"), F.expr(f"x.t = y.t AND x.doc_id <> y.doc_id AND {_size_allows(num, den)}"))
    near = _linked(ordered(stars), sets, num, den, "star")

    label = written(components(near), "components1")
    placed = postings.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_tokens = placed.groupBy("t").agg(F.min("component").alias("u"), F.max("component").alias("v")).where("u <> v").select("t")
    left = written(placed.join(open_tokens, "t", "left_semi").join(facts.select("doc_id", "parity"), "doc_id"), "open")
    across = left.alias("x").join(left.alias("y"), F.expr(f"x.t = y.t AND x.component < y.component AND {_size_allows(num, den)} AND {_sketch_allows(num, den)}"))
    far = _linked(ordered(across), sets, num, den, "across")
    discard(postings, label, left)
    links = written(near.unionByName(far).distinct(), "links")
    discard(near, far)

    classes = written(components(links).withColumnRenamed("id", "first"), "components2")
    known = classes.join(_link_counts(classes, folded, links, sets, num, den), "first", "left")
    discard(sets, links)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    known_rows = lookup(folded.select("doc_id", "n", "first", "copies"), known, "first", "doc_id").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id"), "copies", zero("set_links").alias("set_links"), (zero("row_links") + F.col("copies") - 1).alias("n_links")
    )
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = rest.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), one.alias("copies"), none.alias("set_links"), none.alias("n_links"))
    return known_rows.unionByName(alone)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: All pairs of distinct sets that share a shingle: for small tables.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
k AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS key, g FROM s),
u AS (SELECT key, any_value(n) AS n, any_value(g) AS g, min(doc_id) AS first, count(*) AS copies FROM k WHERE n > 0 GROUP BY key),
x AS (SELECT key, n, unnest(g) AS t FROM u),
p AS (SELECT a.key AS a, b.key AS b FROM x a JOIN x b ON a.t = b.t AND a.key <> b.key GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
r(a, b) AS (SELECT key, key FROM u UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS key, min(first) AS component FROM r JOIN u ON r.b = u.key GROUP BY a),
l AS (SELECT p.a AS key, count(*) AS sets, sum(u.copies) AS held FROM p JOIN u ON p.b = u.key GROUP BY p.a)
SELECT k.doc_id, k.n AS n_shingles, coalesce(component, k.doc_id) AS component_id, coalesce(u.copies, 1) AS copies, coalesce(l.sets, 0) AS set_links, CAST(coalesce(l.held, 0) + coalesce(u.copies, 1) - 1 AS BIGINT) AS n_links
FROM k LEFT JOIN u USING (key) LEFT JOIN c USING (key) LEFT JOIN l USING (key)
"""
