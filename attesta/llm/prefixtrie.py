"""Prefix trie of conversations by an external mergesort that carries longest common prefixes (LCPs).

A turn is ``WIDTH`` bytes: 16 of the SHA-256 of its role and text, and the words of its text. A conversation is its
turns' bytes in a row, so the order of bytes brings all conversations with one beginning together.

1. Runs: each task sorts its conversations, ``RUN_BYTES`` at a time, folds equal ones, and notes for each how many turns
   it shares with the one before. A run is cut at splitters, the quantiles by bytes of a sample, and each cut is written
   front-coded: shared turns are not repeated. Runs lie in the shared folder.
2. Merge: a task takes one range between splitters, all runs' cuts of it, and merges them with a loser tree. Heads know
   how many turns they share with the last winner: where these numbers differ, the greater wins without a look at a
   turn; else turns are compared from there on.
3. Nodes: the merged stream says by its LCPs which nodes of the open path are done; these are added to their parents.
   Paths that reach a range's border may go on in the next one: a range hands on its first and its last path, with what
   hangs on them, and a last pass over these (two a range, whatever the data) finishes their nodes.

Members that end at a node are many only where conversations are equal: their ids are sorted over all tasks, joined
in texts of at most ``CHUNK`` bytes, and hashed as a stream.

Edge cases: null roles and texts are empty; rows that repeat a turn follow by their hash; rows without conv_id belong to
no conversation; negative ids: ``conv_id % of`` has the sign of conv_id; a conversation is one row of ``WIDTH`` bytes a
turn, however long; an empty table has no node; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, discard, lookup, map_batches, table, written

WIDTH = 20  #: bytes of a turn: 16 of its hash, 4 of its words
RUN_BYTES = 16 << 20  #: of turns in a sorted run
PART_BYTES = 32 << 20  #: of turns that a merge is meant to take
SAMPLED = 64  #: conversations sampled for each splitter
CHUNK = 64 << 10  #: bytes of joined ids in a row
FEW = 100_000  #: nodes on borders up to which they are broadcast
OF = 20  #: conversations that share a donor


def turn_bytes(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(words), 8, "0"))


def rebuilt(turns: DataFrame, of: int = OF) -> DataFrame:
    """(conv_id, path): the first h turns of conversation c - c % of, then c's own after its first h; h = crc32(c) % 4.

    One shuffle, by donor: a conversation's turns are put in order where those of its donor are.
    """
    c = F.col("conv_id")
    rows = turns.where("conv_id IS NOT NULL").select(c.cast("long").alias("conv_id"), (c.cast("long") - c.cast("long") % of).alias("donor"), F.struct(F.col("turn").alias("t"), turn_bytes(F.col("role"), F.col("text")).alias("b")).alias("turn"))
    own = rows.repartition("donor").groupBy("donor", "conv_id").agg(F.transform(F.sort_array(F.collect_list("turn")), lambda x: x["b"]).alias("own"))
    given = F.coalesce(F.max(F.when(F.col("conv_id") == F.col("donor"), F.slice("own", 1, 3))).over(Window.partitionBy("donor")), F.array().cast("array<string>"))
    h = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(4)).cast("int")
    both = own.withColumn("given", given).withColumn("h", h)
    return both.select("conv_id", F.unhex(F.array_join(F.concat(F.slice("given", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))), "")).alias("path"))


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Turns that two paths share, if they share ``at``."""
    i, end = at * WIDTH, min(len(a), len(b))
    while i < end and a[i : i + WIDTH] == b[i : i + WIDTH]:
        i += WIDTH
    return i // WIDTH


@dataclass
class Run:
    """Paths in order, front-coded: turns shared with the one before, what follows, members and the least of them."""

    lcp: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    rest: list[bytes] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    least: list[int] = field(default_factory=list)

    def add(self, path: bytes, lcp: int, n: int, least: int) -> None:
        self.lcp.append(lcp)
        self.size.append(len(path) // WIDTH)
        self.rest.append(path[lcp * WIDTH :])
        self.n.append(n)
        self.least.append(least)


def sorted_runs(paths: list[bytes], ids: list[int], splitters: list[bytes]) -> Iterator[tuple[int, Run]]:
    """The sorted run of some conversations, cut at the splitters: (part, cut)."""
    part, run, before, bound = -1, Run(), b"", None
    for i in sorted(range(len(paths)), key=lambda i: (paths[i], ids[i])):
        path = paths[i]
        if run.lcp and path == before:
            run.n[-1] += 1
            continue
        if part < 0 or bound is not None and path >= bound:
            if run.lcp:
                yield part, run
            part, run = bisect_right(splitters, path), Run()
            bound = splitters[part] if part < len(splitters) else None
        run.add(path, shared(before, path) if run.lcp else 0, 1, ids[i])
        before = path
    if run.lcp:
        yield part, run


class Head:
    """The next path of a run, and the turns that it shares with the last winner."""

    __slots__ = ("run", "at", "start", "path", "lcp")

    def __init__(self, run: tuple) -> None:
        self.run, self.at, self.start, self.path, self.lcp = run, -1, 0, b"", 0
        self.next()

    def next(self) -> None:
        self.at += 1
        lcp, size, rest = self.run[:3]
        if self.at == len(lcp):
            self.path = None
            return
        self.lcp = lcp[self.at]
        stop = self.start + (size[self.at] - self.lcp) * WIDTH
        self.path = self.path[: self.lcp * WIDTH] + rest[self.start : stop]
        self.start = stop


def wins(a: Head | None, b: Head | None) -> bool:
    """Whether ``a`` comes before ``b``; the loser then knows the turns that it shares with the winner."""
    if b is None or b.path is None:
        return True
    if a is None or a.path is None:
        return False
    if a.lcp != b.lcp:
        return a.lcp > b.lcp
    m = shared(a.path, b.path, a.lcp)
    i = m * WIDTH
    if a.path[i : i + WIDTH] <= b.path[i : i + WIDTH]:
        b.lcp = m
        return True
    a.lcp = m
    return False


def merged(runs: list[tuple]) -> Iterator[tuple[bytes, int, int, int]]:
    """(path, LCP with the one before, members, least) of all runs in order, by a loser tree.

    A run is (lcps, sizes, rests joined, members, least). Equal paths of several runs follow each other.
    """
    heads: list[Head | None] = [Head(r) for r in runs]
    k = 1
    while k < len(heads):
        k *= 2
    heads += [None] * (k - len(heads))
    losers: list[Head | None] = [None] * k
    round_ = heads
    first = k
    while len(round_) > 1:  # the first tournament, from the leaves up
        first //= 2
        up = []
        for j in range(0, len(round_), 2):
            a, b = round_[j], round_[j + 1]
            if wins(a, b):
                losers[first + j // 2] = b
                up.append(a)
            else:
                losers[first + j // 2] = a
                up.append(b)
        round_ = up
    winner = round_[0] if round_ else None
    leaf = {id(h): k + i for i, h in enumerate(heads) if h is not None}
    while winner is not None and winner.path is not None:
        yield winner.path, winner.lcp, winner.run[3][winner.at], winner.run[4][winner.at]
        at = leaf[id(winner)] // 2
        winner.next()
        while at:
            if not wins(winner, losers[at]):
                winner, losers[at] = losers[at], winner
            at //= 2


@dataclass
class Sums:
    """What is known of a node: members, the least of them, children, leaves and saved tokens below, members that end there."""

    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ended: int = 0
    one: int | None = None  #: a member that ends there

    def add(self, o: Sums) -> None:
        self.n += o.n
        self.least = o.least if self.least is None else self.least if o.least is None else min(self.least, o.least)
        self.children += o.children
        self.leaves += o.leaves
        self.saved += o.saved
        self.ended += o.ended
        self.one = o.one if self.one is None else self.one


def key_of(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()[:16]


class OpenPath:
    """The nodes of the current path that may still grow, from the root on.

    ``rows`` has the finished nodes whose parent is finished, with its least member; ``pending`` those whose parent lies
    on a border, with its key; ``first`` the sums of a first path's nodes, where borders are handed on.
    """

    def __init__(self, borders: bool) -> None:
        self.borders, self.path, self.sums, self.waiting = borders, b"", [], []
        self.first: list[Sums] | None = None
        self.first_path = b""
        self.fixed = 0  #: nodes of the open path that lie on the first path too
        self.rows: list[tuple] = []
        self.pending: list[tuple] = []

    def go(self, path: bytes, lcp: int, at_depths: Iterable[tuple[int, Sums]]) -> None:
        """To the next path in order, which shares ``lcp`` turns with the one before; sums go to its depths."""
        begun = bool(self.sums)
        while len(self.sums) > lcp + 1:
            self.close()
        self.path = path
        while len(self.sums) <= len(path) // WIDTH:
            self.sums.append(Sums())
            self.waiting.append([])
        if self.borders and not begun:
            self.fixed, self.first_path = len(self.sums), path
            self.first = [Sums() for _ in self.sums]
        for depth, s in at_depths:
            self.sums[depth].add(s)

    def close(self) -> None:
        depth, s, own = len(self.sums) - 1, self.sums.pop(), self.waiting.pop()
        if depth < self.fixed:  # it may have begun before this range
            self.fixed = depth
            self.first[depth] = s
            key = key_of(self.path[: depth * WIDTH])
            self.pending += [(*row, key) for row in own]
            return
        words = int.from_bytes(self.path[depth * WIDTH - 4 : depth * WIDTH], "big") if depth else 0
        s.saved += (s.n - 1) * words
        s.leaves += s.children == 0
        self.rows += [(*row, s.least) for row in own]
        key = key_of(self.path[: depth * WIDTH]) if s.ended > 1 or not self.borders else None
        row = (s.least, depth, s.n, s.children, s.leaves, s.saved, s.ended, s.one, key)
        if depth:
            up = self.sums[-1]
            up.add(Sums(s.n, s.least, 1, s.leaves, s.saved))
            self.waiting[-1].append(row)
        else:
            self.rows.append((*row, None))

    def end(self) -> list[tuple[bytes, list[Sums]]]:
        """Closes all nodes; where borders are handed on, gives the range's first and last path with their sums."""
        if not self.sums:
            return []
        if not self.borders:
            while self.sums:
                self.close()
            return []
        last = list(self.sums)
        for depth, own in enumerate(self.waiting):
            key = key_of(self.path[: depth * WIDTH])
            self.pending += [(*row, key) for row in own]
        return [(self.first_path, self.first), (self.path, last)]


_NODE = "least long, depth long, n long, children long, leaves long, saved long, ended long, one long, key binary"
_SUMS = "array<struct<n:bigint,least:bigint,children:bigint,leaves:bigint,saved:bigint,ended:bigint,one:bigint>>"
_PART = f"kind int, {_NODE}, parent_least long, parent_key binary, part int, turn int, path binary, sums {_SUMS}"
_NODE_TYPES = [pa.int64()] * 8 + [pa.binary()]
_SUM_TYPE = pa.struct([(x, pa.int64()) for x in ("n", "least", "children", "leaves", "saved", "ended", "one")])


def _out(kind: int, rows: list[tuple], borders: list[tuple] = ()) -> Iterator[pa.RecordBatch]:
    """Batches of nodes (kind 0), nodes whose parent lies on a border (1), or paths of borders (2)."""
    for at in range(0, len(rows), 10_000):
        cut = rows[at : at + 10_000]
        cols = list(zip(*cut, strict=True))
        none = lambda t: pa.nulls(len(cut), t)  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([
            pa.array([kind] * len(cut), pa.int32()), *(pa.array(c, t) for c, t in zip(cols, _NODE_TYPES, strict=False)),
            pa.array(cols[9], pa.int64()) if kind == 0 else none(pa.int64()), pa.array(cols[9], pa.binary()) if kind == 1 else none(pa.binary()),
            none(pa.int32()), none(pa.int32()), none(pa.binary()), none(pa.list_(_SUM_TYPE)),
        ], names=_NAMES)
    for part, turn, path, sums in borders:
        yield pa.RecordBatch.from_arrays([
            pa.array([2], pa.int32()), *(pa.nulls(1, t) for t in _NODE_TYPES), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
            pa.array([part], pa.int32()), pa.array([turn], pa.int32()), pa.array([path], pa.binary()), pa.array([[vars(s) for s in sums]], pa.list_(_SUM_TYPE)),
        ], names=_NAMES)


_NAMES = ["kind", "least", "depth", "n", "children", "leaves", "saved", "ended", "one", "key", "parent_least", "parent_key", "part", "turn", "path", "sums"]


def cuts_of(paths: DataFrame, splitters: list[bytes], run_bytes: int = RUN_BYTES) -> DataFrame:
    """The sorted runs of the tasks, cut at the splitters: (part, lcp, size, rest, n, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cuts() -> Iterator[pa.RecordBatch]:
            for part, r in sorted_runs(held, ids, splitters):
                yield batch(
                    part=pa.array([part], pa.int32()), lcp=pa.array([r.lcp], pa.list_(pa.int32())), size=pa.array([r.size], pa.list_(pa.int32())),
                    rest=pa.array([b"".join(r.rest)], pa.binary()), n=pa.array([r.n], pa.list_(pa.int64())), least=pa.array([r.least], pa.list_(pa.int64())),
                )

        held, ids, n_bytes = [], [], 0
        for b in batches:
            for i, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(path)
                ids.append(i)
                n_bytes += len(path) + WIDTH
                if n_bytes >= run_bytes:
                    yield from cuts()
                    held, ids, n_bytes = [], [], 0
        yield from cuts()

    return paths.select("conv_id", "path").mapInArrow(run, "part int, lcp array<int>, size array<int>, rest binary, n array<bigint>, least array<bigint>")


def parts_of(cuts: DataFrame, parts: int) -> DataFrame:
    """The nodes of each range, and its border paths. A task holds one range's cuts, front-coded, and its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes() -> Iterator[pa.RecordBatch]:
            trie = OpenPath(borders=True)
            for path, lcp, n, least in merged(runs):
                trie.go(path, lcp, [(len(path) // WIDTH, Sums(n, least, ended=n, one=least))])
                if len(trie.rows) + len(trie.pending) >= 10_000:
                    yield from _out(0, trie.rows)
                    yield from _out(1, trie.pending)
                    trie.rows, trie.pending = [], []
            ends = trie.end()
            yield from _out(0, trie.rows)
            yield from _out(1, trie.pending)
            yield from _out(2, [], [(now, turn, path, sums) for turn, (path, sums) in enumerate(ends)])

        now, runs = None, []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("part", "lcp", "size", "rest", "n", "least")), strict=True):
                if row[0] != now:
                    if runs:
                        yield from nodes()
                    now, runs = row[0], []
                runs.append(row[1:])
        if runs:
            yield from nodes()

    return cuts.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, _PART)


def borders_of(paths: DataFrame) -> DataFrame:
    """The nodes that lie on borders: one pass over two paths a range, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = OpenPath(borders=False)
        for b in batches:
            for path, sums in zip(b.column("path").to_pylist(), b.column("sums").to_pylist(), strict=True):
                trie.go(path, shared(trie.path, path), [(depth, Sums(**s)) for depth, s in enumerate(sums)])
        trie.end()
        yield from _out(0, trie.rows)

    return paths.select("part", "turn", "path", "sums").repartition(1).sortWithinPartitions("part", "turn").mapInArrow(run, _PART)


def joined_ids(paths: DataFrame) -> DataFrame:
    """(key, ends_sha256): of each key, its ids in order, joined by commas.

    Ids are sorted over all tasks, joined there in texts of at most ``CHUNK`` bytes, and a key's texts hashed as they come.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, n_bytes = None, [], 0
        made = lambda: batch(key=pa.array([key], pa.binary()), first=pa.array([ids[0]], pa.int64()), ids=pa.array([",".join(map(str, ids))], pa.string()))
        for b in batches:
            for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (k != key or n_bytes >= CHUNK):
                    yield made()
                    ids, n_bytes = [], 0
                key = k
                ids.append(i)
                n_bytes += 20
        if ids:
            yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        made = lambda: batch(key=pa.array([key], pa.binary()), ends_sha256=pa.array([h.hexdigest()], pa.string()))
        for b in batches:
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if k == key:
                    h.update(b",")
                else:
                    if h:
                        yield made()
                    key, h = k, hashlib.sha256()
                h.update(ids.encode())
        if h:
            yield made()

    n = _shuffles(paths.sparkSession)
    texts = paths.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(chunks, "key binary, first long, ids string")
    return texts.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def _shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def splitters_of(paths: DataFrame, parts: int, n: int) -> list[bytes]:
    """Up to ``parts - 1`` paths that cut all paths in ranges of about equal bytes, from a sample of ``SAMPLED`` a splitter."""
    if parts < 2:
        return []
    step = max(1, n // (parts * SAMPLED))
    taken = sorted(r.path for r in paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(step)) == 0).select("path").toLocalIterator())
    total, out, seen = sum(len(p) + WIDTH for p in taken), [], 0
    for p in taken:
        seen += len(p) + WIDTH
        if seen * parts >= total * (len(out) + 1) and len(out) < parts - 1:
            out.append(p)
    return sorted(set(out))


def trie(paths: DataFrame, part_bytes: int = PART_BYTES, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(conv_id, path) to a row for each distinct beginning: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    paths = written(paths.select("conv_id", "path"), "paths")
    n, size = paths.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path") + WIDTH), F.lit(0))).first()
    parts = max(_shuffles(paths.sparkSession), -(-size // part_bytes))
    splitters = splitters_of(paths, parts, n)
    cuts = written(cuts_of(paths, splitters, run_bytes), "runs")
    done = written(parts_of(cuts, len(splitters) + 1), "nodes")
    border = written(borders_of(done.where("kind = 2")), "borders")
    above = border.select(F.col("key").alias("parent_key"), F.col("least").alias("above"))
    hung = done.where("kind = 1").drop("parent_least")
    if border.count() <= FEW:  # two paths a range: small but for very long conversations
        hung = hung.join(F.broadcast(above), "parent_key")
    else:
        hung = lookup(hung, above, "parent_key", "least")
    node = [c for c in _NAMES[1:10] if c != "key"]
    found = done.where("kind = 0").select(*node, "key", "parent_least").unionByName(border.select(*node, "key", "parent_least")).unionByName(hung.select(*node, "key", F.col("above").alias("parent_least")))
    several = found.where("ended > 1")
    keyed = paths.withColumn("key", F.unhex(F.substring(F.sha2("path", 256), 1, 32)))
    ends = joined_ids(keyed.join(several.select("key"), "key", "left_semi"))
    alone = found.where("ended <= 1").withColumn("ends_sha256", F.sha2(F.encode(F.coalesce(F.col("one").cast("string"), F.lit("")), "UTF-8"), 256))
    every = alone.unionByName(several.join(ends, "key").select(alone.columns))
    out = written(every.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    ), "trie")
    discard(paths, cuts, done, border)
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


OP13_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
e AS (
  SELECT *, substr(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), 1, 32) AS b,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
own AS (
  SELECT c, list({'b': b, 'w': words} ORDER BY turn NULLS FIRST, b) AS s FROM e GROUP BY c),
crc AS (
  WITH RECURSIVE ids AS (SELECT c, CAST(c AS VARCHAR) AS d FROM own),
  x(c, d, i, v) AS (
    SELECT c, d, 0, CAST(4294967295 AS BIGINT) FROM ids
    UNION ALL
    SELECT c, d, i + 1, (SELECT r8 FROM (SELECT
      list_reduce([xor(v, ascii(substr(d, i + 1, 1))), 0, 1, 2, 3, 4, 5, 6, 7], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS r8))
    FROM x WHERE i < length(d))
  SELECT c, xor(v, 4294967295) % 4 AS h FROM x WHERE i = length(d)),
made AS (
  SELECT own.c, list_concat(coalesce(list_slice(g.s, 1, h), []), list_slice(own.s, h + 1, len(own.s))) AS s
  FROM own JOIN crc USING (c) LEFT JOIN own g ON g.c = own.c - own.c % 20),
pre AS (
  SELECT c, d, len(s) AS n, array_to_string(list_transform(list_slice(s, 1, d), lambda x: x.b), '') AS k, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w
  FROM made, unnest(range(0, len(s) + 1)) AS u(d)),
node AS (
  SELECT k, d, min(c) AS c, count(*) AS n, (count(*) - 1) * min(w) AS own, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends
  FROM pre GROUP BY k, d),
kids AS (SELECT left(k, 32 * (d - 1)) AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT left(a.k, 32 * u.d) AS k, u.d AS d, sum(a.own) AS saved, count(*) FILTER (WHERE kids.k IS NULL) AS leaves
  FROM node a LEFT JOIN kids ON kids.k = a.k AND kids.d = a.d, unnest(range(0, a.d + 1)) AS u(d) GROUP BY ALL)
SELECT node.c AS conv_id, node.d AS depth, p.c AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children,
  below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN below ON below.k = node.k AND below.d = node.d LEFT JOIN kids ON kids.k = node.k AND kids.d = node.d
LEFT JOIN node p ON p.d = node.d - 1 AND p.k = left(node.k, 32 * (node.d - 1))
"""
