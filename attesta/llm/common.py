"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts can be long, so batches stay short to bound a worker's memory.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches short for operators that carry whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A session on one machine that names none gets a temporary one; on a cluster that is an error, as executors would
    write where nobody else reads.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]+(,\s*\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="attesta-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/attesta-{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, lost executors lose nothing.

    Spark deletes the write's shuffle files when it has ended, and not when the driver next collects garbage.
    """
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of frames that ``written`` gave, once all that reads them has itself been written."""
    for df in frames:
        remove(df.sparkSession, df.written_path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in the store that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``f`` on each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def batch(**cols: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def with_first(df: DataFrame, keys: list[str], value: str, salts: int = 64) -> DataFrame:
    """``df`` with ``first``, the least ``value`` among the rows of equal ``keys``, and ``copies``, their number.

    Keys are salted by a hash of ``value``: a key with a third of all rows is spread over ``salts`` tasks, partial
    minima come first, and each key's minimum goes back to just the cells that hold its rows.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int"))
    cells = salted.groupBy(*keys, "_salt").agg(F.min(value).alias("first"), F.count("*").alias("copies"))
    firsts = cells.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("copies").alias("copies"), F.collect_set("_salt").alias("_salt"))
    return salted.join(firsts.withColumn("_salt", F.explode("_salt")), [*keys, "_salt"]).drop("_salt")


def lookup(df: DataFrame, other: DataFrame, key: str, spread: str, salts: int = 64) -> DataFrame:
    """Left join with ``other`` (one row for each ``key``), whose rows go to the (key, salt) cells that ``df`` has.

    The salt is a hash of ``spread``, so a key with a third of all rows isn't gathered in one task.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    cells = salted.select(key, "_salt").distinct().join(other, key)
    return salted.join(cells, [key, "_salt"], "left").drop("_salt")
