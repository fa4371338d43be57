"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments; for each, the sum S and the deviation D (root of the squared distances from the
segment's mean) are kept. For segments of length L, <q, x> <= sum(Sq Sx / L + Dq Dx), which is the lower bound of the
distance |q|^2 + |x|^2 - 2 <q, x> given both norms. Bounds are taken with 1, 4 and 16 segments, coarse to fine; each
pass drops the candidates whose bound lies below the k-th exact score found so far, takes the exact scores of the
most promising ones to raise it, and only the last survivors are all computed.

Candidates are packed in blocks of about ``BLOCK`` rows by a hash of their id and row, so that rows that repeat an id
are spread; queries likewise. First every query block meets one block of candidates; the k-th score that a query finds
there is its threshold in all others (a stated query set against all rows). There a query passes over a whole block if
the bound of the block's greatest and least statistics lies below its threshold, and a cell hands on only what reaches
it.

Rows are told apart by vec_id: a query's own rows are no candidates, a repeated query is answered once (with its
least vector), repeated candidates hold a rank each. Vectors that are null, empty, or hold null or non-finite
components, and rows without vec_id, take no part; vectors meet only those of equal length. Scores beyond a long are
clamped, and values beyond exact doubles are multiplied as whole numbers of any size. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BLOCK = 4096  #: candidates in a block
QUERY_BLOCK = 1024  #: queries in a block
LEVELS = (1, 4, 16)
EXACT = float(1 << 53)


def statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Rows of [S / sqrt(L), D] for each segment: their inner products are the bounds."""
    dim = m.shape[1]
    edges = np.unique(np.arange(segments + 1) * dim // segments)
    length = np.diff(edges)
    total = np.add.reduceat(m, edges[:-1], 1)
    square = np.add.reduceat(m * m, edges[:-1], 1)
    return np.concatenate([total / np.sqrt(length), np.sqrt(np.maximum(square - total * total / length, 0))], 1)


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, least_scores: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its id, and the ids and exact scores of its k best (ties to the smaller id) among the vectors.

    Where ``least_scores`` are given, scores below a query's own may be left out.
    """
    if not len(queries) or not len(vectors):
        return
    if np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] >= EXACT:  # beyond exact doubles: whole numbers of any size
        big = vectors.astype(object)
        for q, own in zip(queries.astype(object), query_ids, strict=True):
            at = np.flatnonzero(ids != own)
            score = [min(max(sum(int(a) * int(b) for a, b in zip(q, big[i], strict=True)), -(1 << 63)), (1 << 63) - 1) for i in at]
            top = sorted(range(len(at)), key=lambda i: (-score[i], ids[at[i]]))[:k]
            yield own, ids[at[top]], np.array([score[i] for i in top], np.int64)
        return
    levels = [s for s in LEVELS if s <= queries.shape[1]]
    of_queries, of_vectors = [statistics(queries, s) for s in levels], [statistics(vectors, s) for s in levels]
    coarse = of_queries[0] @ of_vectors[0].T
    slack = 1 + 1e-9 * np.abs(coarse).max()
    floor = np.full(len(queries), -np.inf) if least_scores is None else least_scores.astype(float)
    # what no vector of the block can exceed: each statistic at its greatest or least, at the finest level
    high, low = of_vectors[-1].max(0), of_vectors[-1].min(0)
    of_block = np.maximum(of_queries[-1] * high, of_queries[-1] * low).sum(1)
    for i, own in enumerate(query_ids):
        if min(of_block[i], coarse[i].max()) + slack < floor[i]:
            continue
        q = queries[i]
        left = np.flatnonzero(ids != own)
        bound = coarse[i][left]
        least = floor[i]
        if least > -np.inf:
            left, bound = left[bound + slack >= least], bound[bound + slack >= least]
        for level in range(len(levels)):
            if level:
                bound = of_vectors[level][left] @ of_queries[level][i]
            if len(left) > 4 * k:
                probe = np.argpartition(-bound, 4 * k)[: 4 * k]
                scores = vectors[left[probe]] @ q
                least = max(least, np.partition(scores, -k)[-k])
                left = left[bound + slack >= least]
        scores = vectors[left] @ q
        left, scores = left[scores >= floor[i]], scores[scores >= floor[i]]
        top = np.lexsort((ids[left], -scores))[:k]
        yield own, ids[left[top]], scores[top].astype(np.int64)


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    x = F.col(vector_col)
    good = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"))


def _packed(rows: DataFrame, blocks: int, scale: float) -> DataFrame:
    """Rows in blocks by a hash of their id: (block, dim, ids, data)."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.floor(np.stack(pdf["v"].to_numpy()).astype(np.float64) * scale)
        small = m.astype(np.float32)
        data = small if np.array_equal(small, m) else m
        return pd.DataFrame({"block": [key[0]], "dim": [key[1]], "width": [data.itemsize], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()]})

    keyed = rows.withColumn("row", F.monotonically_increasing_id()).select("id", "v", F.pmod(F.xxhash64("id", "row"), F.lit(blocks)).alias("block"), F.size("v").alias("dim"))
    return keyed.groupBy("block", "dim").applyInPandas(pack, "block long, dim int, width int, ids binary, data binary")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which ``is_query`` (a column of ``id``) holds."""
    rows = taking_part(vectors, id_col, vector_col)
    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    n, m = rows.select(F.count("*"), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    candidates = written(_packed(rows, blocks, scale), "vectors")
    queries = written(_packed(asked, query_blocks, scale), "queries").select("dim", F.col("width").alias("qwidth"), F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.col("block").alias("qblock"))
    load = lambda data, width, dim: np.frombuffer(data, f"<f{width}").reshape(-1, dim).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                floor = None if r["least"] is None else np.frombuffer(r["least"], np.int64)
                out = list(best(load(r["qdata"], r["qwidth"], r["dim"]), np.frombuffer(r["qids"], np.int64), load(r["data"], r["width"], r["dim"]), np.frombuffer(r["ids"], np.int64), k, floor))
                q = np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64) if out else np.zeros(0, np.int64)
                cat = lambda j: np.concatenate([x[j] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(cat(1)), pa.array(cat(2))], ["query_id", "vec_id", "score"])

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th score of each query in the seed block, in the order of qids; a long's least where there are fewer."""
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["qids"], np.int64)
                kth = {own: int(s[-1]) for own, _, s in best(load(r["qdata"], r["qwidth"], r["dim"]), ids, load(r["data"], r["width"], r["dim"]), np.frombuffer(r["ids"], np.int64), k) if len(s) == k}
                least = np.array([kth.get(i, -(1 << 63)) for i in ids.tolist()], np.int64)
                yield pa.RecordBatch.from_pydict({"qblock": [r["qblock"]], "dim": pa.array([r["dim"]], pa.int32()), "least": [least.tobytes()]})

    sides = ["dim", "width", "ids", "data", "qwidth", "qids", "qdata"]
    sown = candidates.where("block = 0").select("dim", "width", "ids", "data")
    known = written(queries.join(sown.hint("shuffle_hash"), "dim").select("qblock", *sides).mapInArrow(seed, "qblock long, dim int, least binary"), "thresholds")
    asked_cells = queries.join(known, ["qblock", "dim"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    cells = candidates.join(asked_cells.hint("shuffle_hash"), ["block", "dim"])
    found = cells.select(*sides, "least").mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP3_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.v) = len(c.v) WHERE q.id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
