"""Byte-level BPE by recursive DuckDB queries in each partition.

Texts are split by the tokenizer's pattern. The distinct words of a batch that aren't cached become token-position
rows (word and position in one id, tok), at first a row for each byte. A recursive query joins neighbouring rows with the merge
table (left, right, rank), which holds every split of every token, and contracts leftmost pairs of least rank until
none is left. Its table is keyed by position: a step writes the changed positions only, and looks only at words that
the step before has changed, so a word of any length takes space in proportion to it.

A step contracts the leftmost pair of least rank of each word, and every other pair that is so among all that can reach
it: what happens further off can't touch it first. A pair is reached through tokens that hold bytes of it, and a token has
at most L bytes (the longest one made of the batch's bytes). So a pair that is the least among those that begin within
NEAR x L bytes of it would be contracted later in any case, with the same neighbours: L bytes are what can change its
tokens, L more what its new token can lead to at lower ranks, and L keep two such pairs of one step apart. The steps of a
word thus don't grow with its length. Words of at most NEAR x L bytes are within reach as a whole, so there the least is
an aggregate by word; for longer ones it is a window by position.

Where such a pair of least rank occurs again within reach, a step contracts these occurrences too, from left to
right and without overlaps: they would be the next ones, as long as the token that they make can't begin or end a
token of lower rank, and none of their overlapping run has lower ranks within its own reach. Pairs whose token can
(``alone``) are contracted only as the leftmost.

Decoding joins id-position rows with the vocabulary; an ordered string aggregate puts the bytes of each document
back together.

Edge cases: null texts are empty and have no tokens; null ids are kept; words and texts of any length take the same
query; repeated rows give repeated results; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import batch, map_batches, short_batches, table

STEP_BYTES = 100_000  #: bytes of words, the shortest first, that one recursive query takes (a longer word has one of its own)
TEXT_CHARS = 1_500_000  #: characters of texts whose new words are learnt together
CACHE = 300_000  #: words whose ids a worker keeps, and as many older ones
DECODE_TOKENS = 1_000_000  #: tokens that one decoding query takes
MEMORY = "400MB"
NEAR = 3  #: longest tokens between a pair and what can't reach it

_ENCODE = """
WITH RECURSIVE t(id, tok) USING KEY (id) AS (
  SELECT (word << 32) | pos, tok FROM start
  UNION
  (WITH n AS (
    SELECT id, tok, lead(tok) OVER w AS after, lead(id) OVER w AS next FROM recurring.t
    WHERE tok >= 0 AND id >> 32 IN (SELECT id >> 32 FROM t) WINDOW w AS (ORDER BY id)),
  p AS (
    SELECT n.id, n.next, m.rank, m.alone, (m.rank << 32) | (n.id & 4294967295) AS place
    FROM n JOIN merges m ON n.tok = m.l AND n.after = m.r WHERE n.next >> 32 = n.id >> 32),
  {pairs},
  r AS (
    SELECT *, max(CASE WHEN tied IS NOT TRUE THEN nth END) OVER w AS run, max(CASE WHEN least >> 32 < rank THEN nth END) OVER w AS late
    FROM c WINDOW w AS (ORDER BY id)),
  d AS (
    SELECT id, next, rank FROM r
    WHERE CASE WHEN alone THEN place = least ELSE least >> 32 = rank AND (nth - run) % 2 = 0 AND coalesce(late < run, true) END)
  SELECT id, rank FROM d UNION ALL SELECT next, -1 FROM d))
SELECT id >> 32 AS word, tok FROM t WHERE tok >= 0 ORDER BY id
"""
# pairs with the least (rank, position) of what can reach them: of the word, where no word is longer than that, or nearby
_OF_WORD = """
  b AS (SELECT id >> 32 AS word, min(place) AS least FROM p GROUP BY 1),
  c AS (
    SELECT p.*, b.least, row_number() OVER w AS nth, lag(next) OVER w = id AS tied
    FROM p JOIN b ON p.id >> 32 = b.word AND p.rank = b.least >> 32 WINDOW w AS (ORDER BY id))"""
_NEARBY = """
  c AS (
    SELECT *, row_number() OVER w AS nth, lag(next) OVER w = id AND lag(rank) OVER w = rank AS tied,
      min(place) OVER (ORDER BY id RANGE BETWEEN {before} PRECEDING AND {behind} FOLLOWING) AS least
    FROM p WINDOW w AS (ORDER BY id))"""
_DECODE = "SELECT doc, string_agg(v.bytes, '' ORDER BY pos) AS bytes FROM ids JOIN vocabulary v USING (tok) GROUP BY doc"


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file on the machine that runs this."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Coder:
    """Encoder and decoder of one worker process."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.longest = sorted(self.ranks, key=len, reverse=True)
        self.near = NEAR * len(self.longest[0])
        rows = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None
        ]
        left, right, rank = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})  # nothing is spilled
        self.db.register("merge_rows", pa.table({"l": left, "r": right, "rank": rank}))
        self.db.execute("CREATE TABLE merges AS SELECT *, rank IN (SELECT greatest(l, r) FROM merge_rows WHERE rank <= greatest(l, r)) AS alone FROM merge_rows")
        self.db.unregister("merge_rows")
        # bytes as the characters of equal number, so that strings can be aggregated
        tokens = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int64()), "bytes": pa.array([t.decode("latin-1") for t in self.ranks], pa.string())})
        self.db.register("token_rows", tokens)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM token_rows")
        self.db.unregister("token_rows")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, by the recursive query, as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        start = pa.table({
            "word": pa.array(np.repeat(np.arange(len(words)), sizes)),
            "pos": pa.array(np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)),
            "tok": pa.array(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]),
        })
        self.db.register("start", start)
        pairs = _OF_WORD
        if sizes.max() > self.near:
            reach = self._reach(words)
            pairs = _NEARBY.format(before=NEAR * reach, behind=(NEAR + 1) * reach)
        out = self.db.execute(_ENCODE.format(pairs=pairs)).fetchnumpy()
        self.db.unregister("start")
        cuts = (4 * np.searchsorted(out["word"], np.arange(len(words) + 1))).tolist()
        raw = out["tok"].astype("<u4").tobytes()
        return [raw[a:b] for a, b in itertools.pairwise(cuts)]

    def _reach(self, words: list[bytes]) -> int:
        """Bytes of the longest token that consists of bytes of ``words``."""
        found = set().union(*words)
        return next((len(t) for t in self.longest if found.issuperset(t)), 1)

    def learn(self, words: list[str]) -> None:
        open_ = []
        for w in words:
            raw = w.encode()
            if (whole := self.ranks.get(raw)) is not None:  # a word that is a token is that token
                self.cache[w] = np.array([whole], "<u4").tobytes()
            else:
                open_.append((len(raw), w, raw))
        open_.sort(key=lambda x: x[0])
        at = 0
        while at < len(open_):
            end, size = at, 0
            while end < len(open_) and (end == at or size + open_[end][0] <= STEP_BYTES and (open_[at][0] > self.near or open_[end][0] <= self.near)):
                size += open_[end][0]
                end += 1
            coded = self._contract([raw for _, _, raw in open_[at:end]])
            self.cache.update(zip((w for _, w, _ in open_[at:end]), coded, strict=True))
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.cache) > CACHE:  # words that turn up again come back from the older half, the others go
            self.cache, self.older = {}, self.cache
        missing = set().union(*split).difference(self.cache)
        if self.older:
            back = missing & self.older.keys()
            self.cache.update((w, self.older[w]) for w in back)
            missing -= back
        self.learn(list(missing))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        out = [b""] * len(coded)
        at = 0
        while at < len(coded):
            end, size = at, 0
            while end < len(coded) and (end == at or size + len(coded[end]) // 4 <= DECODE_TOKENS):
                size += len(coded[end]) // 4
                end += 1
            sizes = np.array([len(c) // 4 for c in coded[at:end]], np.int64)
            ids = np.frombuffer(b"".join(coded[at:end]), "<u4")
            self.db.register("ids", pa.table({"doc": np.repeat(np.arange(at, end), sizes), "pos": np.arange(len(ids)), "tok": ids.astype(np.int64)}))
            for doc, text in self.db.execute(_DECODE).fetchall():
                out[doc] = text.encode("latin-1")
            self.db.unregister("ids")
            at = end
        return out


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each text, little-endian unsigned 32-bit."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for b in batches:
            held.append((b.column(0), [t or "" for t in b.column(1).to_pylist()]))
            chars += sum(map(len, held[-1][1]))
            if chars >= TEXT_CHARS:
                yield from flush(held)
                held, chars = [], 0
        yield from flush(held)

    def flush(held: list[tuple[pa.Array, list[str]]]) -> Iterator[pa.RecordBatch]:
        coded = iter(coder(path, pattern).encode([t for _, texts in held for t in texts]) if held else [])
        for ids, texts in held:
            if texts:
                yield batch(**{id_col: ids, "ids": pa.array([next(coded) for _ in texts], pa.binary())})

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, bytes): ids as encode() gives them, and the bytes that they stand for."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column("ids")
        return batch(**{id_col: b.column(id_col), "ids": ids, "bytes": pa.array(coder(path, pattern).decode([x or b"" for x in ids.to_pylist()]), pa.binary())})

    return map_batches(coded.select(id_col, "ids"), f, f"{id_col} {coded.schema[id_col].dataType.simpleString()}, ids binary, bytes binary")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decoded.selectExpr(id_col, "octet_length(ids) div 4 AS n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(bytes, 256) AS decoded_sha256")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    path = p.path("byte_bpe_multi_50k.tiktoken")
    return digests(decode(encode(table(spark, sf_dir, "documents"), path, p.PATTERN), path, p.PATTERN))
