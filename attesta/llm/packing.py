"""Best-fit packing under conflicts.

Documents become pieces of at most ``capacity`` bytes of UTF-8 (each followed by one separator byte); pieces go into
bins of that capacity. A bin holds at most one piece of each source and one of each duplicate cluster. (``slots`` lets
a bin take that many pieces of one source, one of each slot that a hash deals; 1 is the default, the source itself.)

Pieces are dealt by a hash to shards of about ``SHARD`` pieces and ``SHARD_BYTES`` bytes, which are packed
independently: no source, no group of copies and no run of repeated rows is ever gathered in one task, and "tightest"
is meant within a shard. In a shard, pieces go from the longest to the shortest. Open bins are ordered by residual and
carry a bitmap of their sources and one of their clusters: a search starts at the least residual that is enough and
takes successors until a bin without the piece's bits turns up: the tightest compatible one. If none does, a bin is
opened.

Edge cases: null and empty texts take their separator only; null doc_ids are kept; null sources are a source; texts of
any length are cut, never shortened; repeated rows are copies of one cluster, and so in different bins; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CAPACITY = 32_768  #: bytes in a bin
SLOTS = 1  #: pieces of one source that a bin may hold, one of each slot
SHARD, SHARD_BYTES = 8192, 64 << 20  #: pieces, and bytes of them, that are packed together


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(bin, position, offset) of each piece, which come in the order of packing."""
    many_s, many_c = Counter(sources), Counter(clusters)
    bit_s = {v: 1 << i for i, v in enumerate(sorted(v for v, n in many_s.items() if n > 1))}  # what occurs once can't conflict
    bit_c = {v: 1 << i for i, v in enumerate(sorted(v for v, n in many_c.items() if n > 1))}
    shift = len(sizes).bit_length()  # there are no more bins than pieces
    order: list[int] = []  # residual << shift | bin
    used: list[list[int]] = []  # of each bin: source bits, cluster bits, pieces, bytes
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = bit_s.get(source, 0), bit_c.get(cluster, 0)
        at = bisect_left(order, size << shift)
        while at < len(order):
            b = order[at] & (1 << shift) - 1
            have = used[b]
            if not (have[0] & s or have[1] & c):
                del order[at]
                break
            at += 1
        else:
            b = len(used)
            have = [0, 0, 0, 0]
            used.append(have)
        out.append((b, have[2], have[3]))
        have[0] |= s
        have[1] |= c
        have[2] += 1
        have[3] += size
        if have[3] < capacity:
            insort(order, capacity - have[3] << shift | b)
    return out


def pieces(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, slots: int = SLOTS, content: bool = False) -> DataFrame:
    """(doc_id, piece, start, n_bytes, size, slot, cluster, row[, content]): n_bytes from byte ``start`` of the text."""
    room = capacity - 1
    text = F.coalesce(F.col("text"), F.lit(""))
    cluster = F.xxhash64(text) if cluster is None else cluster
    slot = F.xxhash64(F.coalesce("source", F.lit("\0")), F.pmod(F.xxhash64("doc_id", text), F.lit(slots))) if slots > 1 else F.xxhash64(F.coalesce("source", F.lit("\0")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n"), cluster.cast("long").alias("cluster"), slot.alias("slot"),
        F.monotonically_increasing_id().alias("row"),  # tells repeated rows apart, for dealing only
        *([F.encode(text, "UTF-8").alias("whole")] if content else []),
    )
    cut = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / room)).cast("long"))).alias("piece"))
    n = F.least(F.lit(room).cast("long"), F.col("n") - F.col("piece") * room)
    start = F.col("piece") * room
    own = [F.substring("whole", start.cast("int") + 1, n.cast("int")).alias("content")] if content else []
    return cut.select("doc_id", "piece", start.alias("start"), n.alias("n_bytes"), (n + 1).alias("size"), "slot", "cluster", "row", *own)


def pack(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, slots: int = SLOTS, shard_rows: int = SHARD, content: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, n_bytes, bin_id, position and offset in the bin, and its bytes if ``content``.

    ``docs`` has doc_id, text and source; ``cluster`` tells duplicates apart (by default, equal texts).
    """
    n, size = pieces(docs, cluster, capacity, slots).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = max(1, -(-n // shard_rows), -(-size // SHARD_BYTES))
    cut = pieces(docs, cluster, capacity, slots, content)
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece", "row"), F.lit(shards)))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], ignore_index=True)
        placed = best_fit(pdf["size"].tolist(), pdf["slot"].tolist(), pdf["cluster"].tolist(), capacity)
        b, position, offset = zip(*placed, strict=True)
        out = pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64"), "piece": pdf["piece"], "start": pdf["start"], "n_bytes": pdf["n_bytes"],
            "bin_id": [key[0] << 32 | x for x in b], "position": position, "offset": offset,
        })
        return out.assign(content=pdf["content"]) if content else out

    kind = "doc_id long, piece long, start long, n_bytes long, bin_id long, position int, offset long"
    return dealt.groupBy("shard").applyInPandas(one, kind + ", content binary" * content)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
