"""Fill-in-middle over whole tokens, cut by succinct rank and select.

A batch's texts lie in one buffer of UTF-8. Two bitvectors are packed over its bytes: the last byte of each token, and
the first byte of each code point. Each has a directory with the popcount before every block of ``BLOCK`` bytes of bits.
A text's tokens are the rank at its end less that at its start, a cut after k of them is one select, and lengths in code
points are ranks again: no token is ever made an object, and long texts cost one bit a byte.

Tokens are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, left to right: a run without white space with
the white space before it, and what white space ends the text. White space is ASCII, so ends are seen in single bytes.

Edge cases: a null text is empty and stays plain; texts that hold a mark stay plain; a null doc_id is written as nothing
in the hashed key; repeated rows give repeated results; texts of any length are cut whole, in batches of few rows; an
empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_batches, short_batches, table

SEED = 42
RATE, SPM_RATE = 50, 80  #: of a hundred: documents transformed, and of those the ones in suffix-prefix-middle order
BLOCK = 64  #: bytes of bits that share an entry of the directory

# The marks.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_P, _S, _M = (m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Place of the (j + 1)th one in a byte of bits, the highest bit first.
_PLACE = np.array([([k for k in range(8) if b >> (7 - k) & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)


class Bits:
    """A packed bitvector with rank and select, both over arrays of arguments."""

    def __init__(self, bits: np.ndarray) -> None:
        self.size = len(bits)
        packed = np.packbits(bits)
        self.bytes = np.concatenate([packed, np.zeros(-len(packed) % BLOCK + BLOCK, np.uint8)])
        ones = _COUNT[self.bytes].reshape(-1, BLOCK)
        self.before = np.concatenate([[0], np.cumsum(ones.sum(axis=1, dtype=np.int64))])  #: ones before each block
        self.ones = int(self.before[-1])

    def _within(self, block: np.ndarray) -> np.ndarray:
        """Ones up to and with each byte of the blocks, a row for each."""
        return np.cumsum(_COUNT[self.bytes.reshape(-1, BLOCK)[block]], axis=1, dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        byte, bit = np.divmod(at, 8)
        block, own = np.divmod(byte, BLOCK)
        rows = np.arange(len(at))
        past = np.where(own > 0, self._within(block)[rows, own - 1], 0)
        part = self.bytes[byte] & (0xFF00 >> bit & 0xFF)
        return self.before[block] + past + _COUNT[part]

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Place of each nth one, counted from 1."""
        block = np.searchsorted(self.before, nth, side="left") - 1
        left = nth - self.before[block]
        within = self._within(block)
        own = (within < left[:, None]).sum(axis=1)
        rows = np.arange(len(nth))
        left = left - np.where(own > 0, within[rows, own - 1], 0)
        byte = block * BLOCK + own
        return byte * 8 + _PLACE[self.bytes[byte], left - 1]


def token_ends(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Bits:
    """The last byte of each token of the texts that lie at [start, stop) of ``data``."""
    space = _SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    ends[stops[stops > starts] - 1] = True  # whatever ends a text ends a token
    return Bits(ends)


def key_hashes(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, one after the other, and where each begins; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): each text's tokens, the order that it is given and its new text."""
    short_batches(docs.sparkSession)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column(0).to_pylist()
        data, at = buffer_of(b.column(1))
        starts, stops = at[:-1], at[1:]
        ends, chars = token_ends(data, starts, stops), Bits((data & 0xC0) != 0x80)
        base = ends.rank(starts)
        n = ends.rank(stops) - base
        h = np.array([key_hashes(i, seed) for i in ids], np.int64).reshape(-1, 4)
        one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        cut = lambda k: np.where(k > 0, ends.select(np.maximum(base + k, 1)) + 1, starts) if ends.ones else starts
        lo, hi = cut(np.minimum(one, two)), cut(np.maximum(one, two))
        prefix, middle = chars.rank(lo) - chars.rank(starts), chars.rank(hi) - chars.rank(lo)
        raw = data.tobytes()
        form, out = [], []
        for i, (a, x, y, z) in enumerate(zip(starts.tolist(), lo.tolist(), hi.tolist(), stops.tolist(), strict=True)):
            if a == z or h[i, 2] % 100 >= rate or any(0 <= raw.find(m, a, z) for m in (_P, _S, _M)):
                form.append("plain")
                out.append(raw[a:z])
            elif h[i, 3] % 100 < spm_rate:
                form.append("spm")
                out.append(b"".join((_S, raw[y:z], _P, raw[a:x], _M, raw[x:y])))
            else:
                form.append("psm")
                out.append(b"".join((_P, raw[a:x], _S, raw[y:z], _M, raw[x:y])))
        plain = np.array([k == "plain" for k in form], bool)
        return batch(**{
            id_col: b.column(0), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(prefix, pa.int64(), mask=plain),
            "middle_chars": pa.array(middle, pa.int64(), mask=plain), "output": pa.array(out, pa.binary()).cast(pa.string()),
        })

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), f, f"{id_col} {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of an output: a text with marks stays plain, so those that an output holds are the transformation's own."""
    part = F.split(output, "<[PSM]>", -1)
    joined = lambda *places: F.concat(*[F.get(part, F.lit(i)) for i in places])
    return F.when(form == "plain", output).when(form == "psm", joined(1, 3, 2)).otherwise(joined(2, 3, 1))


def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (
  SELECT *, array_to_string(list_slice(u, 1, a), '') AS x, array_to_string(list_slice(u, a + 1, b), '') AS y,
    array_to_string(list_slice(u, b + 1, n), '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
