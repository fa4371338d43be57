"""Secret scans: keyword automaton first, anchored patterns only at its hits, checksums last.

An Aho-Corasick automaton finds the keywords in a text folded from A-Z to a-z (code points keep their places).
Patterns are tried only at a hit, at its own position. Long hex runs have no keyword; they are found by probing:
a run of 24 holds two neighbouring probes that are 12 apart, so only texts with such probes are searched.
Tokens with an embedded checksum (three-letter prefix, 30 characters, six base-62 digits of their CRC-32) become
spans of kind ``checked`` only where the checksum holds.

Edge cases: null and empty texts have no spans; null ids are kept; texts of any length are searched whole, in batches
of few rows; repeated rows give repeated results; an empty table gives an empty one; further columns are kept by
``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_batches, short_batches, table

# Keywords, patterns and least lengths of the kinds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "AKIA"
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "checked")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_FOLD = {c: c + 32 for c in range(65, 91)}
_automaton: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        a = ahocorasick.Automaton()
        for w in ASSIGN_WORDS:
            a.add_word(w, (0, len(w)))
        a.add_word(ACCESS_WORD.lower(), (1, len(ACCESS_WORD)))
        for w in CHECKED_WORDS:
            a.add_word(w, (3, len(w)))
        a.make_automaton()
        _automaton = a
    return _automaton


def checksum(body: str) -> str:
    """Six base-62 digits of the body's CRC-32."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by start, then kind. Each kind: leftmost, without overlaps."""
    if not text:
        return []
    found, until = [], [0, 0, 0, 0]
    lowered = text.lower() if text.isascii() else text.translate(_FOLD)
    for last, (kind, length) in automaton().iter(lowered):
        start = last + 1 - length
        if start < until[kind]:
            continue
        m = (ASSIGN, ACCESS, HEX, CHECKED)[kind].match(text, start)
        if not m:
            continue
        until[kind] = m.end()
        if kind == 0 and m.end(1) - m.start(1) >= LEAST_ASSIGN or kind == 1 and m.end() - start >= LEAST_ACCESS or kind == 3 and checksum(m[1]) == m[2]:
            found.append((kind, start, m.end()))
    probes = text[::12]
    if _PROBE.search(probes):
        found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


_PROBE = re.compile(r"[0-9a-f]{2}")


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_checked, base_sha256, spans) of each document."""
    short_batches(docs.sparkSession)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        every = [spans(t) for t in b.column(1).to_pylist()]
        counts = {f"n_{name}": pa.array([sum(s[0] == k for s in x) for x in every], pa.int64()) for k, name in enumerate(KINDS)}
        base = [hashlib.sha256(joined([s for s in x if s[0] < 3]).encode()).hexdigest() for x in every]
        return batch(**{id_col: b.column(0)}, **counts, base_sha256=pa.array(base, pa.string()), spans=pa.array([joined(x) for x in every], pa.string()))

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), f, f"{id_col} {kind}, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by ``mark``; a null stays null."""
    if not (found := spans(text)):
        return text
    out, at, end = [], 0, -1
    for _, a, b in found:
        if a >= end:
            out += [text[at:a] if end < 0 else text[end:a], mark]
            end = b
        else:
            end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns, secrets replaced; ``length_col``, where there is one, follows the new text."""
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        col = b.column(at)
        return b.set_column(at, b.schema.field(at), pa.array([redacted(t) for t in col.to_pylist()], col.type))

    out = map_batches(docs, f, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.char_length(text_col)).cast(docs.schema[length_col].dataType))
    return out


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
