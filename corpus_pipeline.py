"""Corpus pipeline: toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet in the shared
folder before the next one reads it. All but the last return the columns that they were given, whatever their names.
Empty tables pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm import jaccard, packing, secrets, toxicity
from attesta.llm.common import short_batches, table, with_first, written

#: Near duplicates here: five-word shingles, similarity 0.8.
SHINGLE, NUM, DEN = 5, 80, 100


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the labels of the corpus teach the lexicon.

    Null texts score as empty ones; rows that repeat a document stay or go together; without labels nothing goes.
    """
    short_batches(spark)
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the one of least doc_id stays; without doc_id or words, all stay.

    Rows that repeat a doc_id with other texts are documents of their own: the one of least (doc_id, key) stays.
    """
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        classes = written(jaccard.join(docs, SHINGLE, NUM, DEN).select("doc_id", "component_id"), "classes")
        dropped = written(classes.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")  # broadcast by Spark only if its files are small
        return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    keyed = docs.withColumn("_key", jaccard.row_key())
    classes = jaccard.join(keyed.select(F.col("_key").alias("doc_id"), "text"), SHINGLE, NUM, DEN).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_key"), "component_id").distinct()
    ranked = classes.join(keyed.select("_key", "doc_id").distinct(), "_key").select("component_id", F.struct("doc_id", "_key").alias("v"))
    best = written(with_first(ranked, ["component_id"], "v").where("v = first").select("v._key"), "kept")
    # rows of one doc_id and text are copies: one stays, the first by the other columns
    order = Window.partitionBy("_key").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")], "doc_id")
    kept = keyed.join(best, "_key", "left_semi").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select(docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every row stays, null texts as they are."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: each piece of each document with its bytes, its bin and its place there.

    Null texts take a separator only; copies, and documents of one source, lie in different bins.
    """
    return packing.pack(docs, content=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("ngram_jaccard", near_duplicates),
    ("secret_scans", secret_scans),
    ("best_fit_packing", packed),
]
#: SQL can't express the learnt lexicon and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
