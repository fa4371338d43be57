"""Tables that grow by batches: merges by key bucket, blocks of ids, and bodies kept once.

A merge reads and rewrites the buckets that a batch's keys fall in; other buckets' files stay as they are. Ids come in
blocks, and a block is taken by making its file, which only one writer can. A batch has a folder of its own, so batches
may be written at the same time.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import upsert
from .scan import materialised

BUCKETS = 64
BLOCK = 1 << 20  #: ids in a block


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new store of rows that are one for each key. Null keys are keys."""
    _bucketed(rows, keys, buckets).repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


def merge(path: str, incoming: DataFrame, keys: list[str], order: list[str], updated: list[str], keep_first_known: list[str] = (), buckets: int = BUCKETS) -> list[int]:
    """Upserts a batch (see ``relational.upsert``) and returns the buckets that it rewrote.

    Which those are is asked of the batch alone, at most ``buckets`` numbers. Only they are read, and only they are
    replaced, each by a rename when all tasks have ended; one merge of a store runs at a time.
    """
    spark = incoming.sparkSession
    batch = materialised(incoming)
    touched = sorted(r[0] for r in _bucketed(batch, keys, buckets).select("_bucket").distinct().collect())
    if touched:
        old = spark.read.parquet(path).where(F.col("_bucket").isin(touched)).drop("_bucket")
        new = upsert(old, batch.select(old.columns), keys, order, updated, keep_first_known)
        _bucketed(new, keys, buckets).repartition(len(touched), "_bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("_bucket").parquet(path)
    return touched


def _made(spark: SparkSession, uri: str) -> bool:
    """Whether this call made the file; false if it was there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":  # whose Java calls look first and make then
        os.makedirs(os.path.dirname(path.toUri().getPath()), exist_ok=True)
        try:
            os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(path, False).close()
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    return True


def reserve(spark: SparkSession, folder: str, n: int) -> list[int]:
    """``n`` blocks of ids that no other caller gets, in order."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    taken = [int(f.getPath().getName()) for f in fs.listStatus(fs_path) if f.getPath().getName().isdigit()] if fs.exists(fs_path) else []
    out, at = [], max(taken, default=-1) + 1
    while len(out) < n:
        if _made(spark, f"{folder.rstrip('/')}/{at:012d}"):
            out.append(at)
        at += 1
    return out


def append(rows: DataFrame, path: str, id_col: str, block: int = BLOCK) -> DataFrame:
    """Adds rows to a log, with ids that no other batch has, and returns them.

    Rows are written down and counted by partition before ids are taken; a row's id is its partition's offset and its
    place there, within the blocks taken. Ids grow in a batch without gaps but at ends of blocks.
    """
    spark = rows.sparkSession
    held = materialised(rows).withColumn("_part", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted(held.groupBy("_part").count().collect())  # two numbers a partition
    total, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    blocks = reserve(spark, f"{path.rstrip('/')}/_ids", max(1, -(-total // block)))
    to = f"{path.rstrip('/')}/batch={blocks[0]}"
    at = F.col("_off") + F.col("_i")
    firsts = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "_nth long, _block long")  # one a block
    placed = held.join(F.broadcast(spark.createDataFrame(offsets, "_part int, _off long")), "_part").withColumn("_nth", F.floor(at / block))
    placed.join(F.broadcast(firsts), "_nth").select((F.col("_block") * block + at % block).alias(id_col), *rows.columns).write.parquet(to)
    return spark.read.parquet(to)


def log(spark: SparkSession, path: str) -> DataFrame:
    """All rows that batches have added."""
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/batch=*").drop("batch")


def keep_bodies(bodies: DataFrame, path: str) -> DataFrame:
    """Writes the bodies (digest, body) whose digest the store lacks, each once, and returns their digests.

    Within a batch bodies lie by the first two digits of their digest; only the shards that a new batch has are looked
    through. Two batches at one time may both bring a body: ``bodies`` reads the one of the earlier batch.
    """
    spark = bodies.sparkSession
    new = materialised(bodies.where("digest IS NOT NULL").groupBy("digest").agg(F.min("body").alias("body")).withColumn("shard", F.substring("digest", 1, 2)))
    if (known := _bodies(spark, path)) is not None:
        shards = [r[0] for r in new.select("shard").distinct().collect()]  # at most 256
        new = materialised(new.join(known.where(F.col("shard").isin(shards)).select("digest"), "digest", "left_anti"))
    batch = reserve(spark, f"{path.rstrip('/')}/_batches", 1)[0]
    new.repartition("shard").write.partitionBy("shard").parquet(f"{path.rstrip('/')}/batch={batch}")
    return new.select("digest")


def _bodies(spark: SparkSession, path: str) -> DataFrame | None:
    """The bodies of all batches that have been written, if there is one."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("batch=")] if fs.exists(root) else []
    done = [p.toString() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return spark.read.schema("digest string, body string, batch long, shard string").option("basePath", path).parquet(*done) if done else None


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """(digest, body), one for each digest."""
    found = _bodies(spark, path)
    if found is None:
        return spark.createDataFrame([], "digest string, body string")
    return found.groupBy("digest").agg(F.min_by("body", "batch").alias("body"))
