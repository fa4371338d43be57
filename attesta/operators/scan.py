"""Associative scans along the rows of a key, in which no key is one task.

A key's rows are dealt to cells: ranges of their order, by a rule on the row itself (its hour, its year, its block of
positions) or by quantiles of all rows. Running values are made within each cell, each cell gives its totals, totals
are scanned over the cells of a key (one row a cell), and what lies before a cell is carried back to its rows. Rows are
shuffled once, by key and cell; totals come from the same shuffle and join it.

Null keys are keys. Rows at one place of the order share a cell, but for ``quantile_cells`` with a second column.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

Step = dict[str, Callable[[WindowSpec], Column]]


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def past(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def scanned(df: DataFrame, keys: list[str], order: list[str | Column], cell: Column, local: list[Step], totals: dict[str, Column], before: list[Step]) -> DataFrame:
    """``df`` with running values and carries.

    ``cell`` grows with the order. ``local`` are steps of columns over a cell's rows in order, ``totals`` aggregates of a
    cell's rows, ``before`` steps of columns over the totals of a key's cells in order; steps may use earlier ones'.
    """
    rows = df.withColumn("_key", F.struct(*keys)).withColumn("_cell", cell)
    within = Window.partitionBy("_key", "_cell").orderBy(*order)
    for step in local:
        rows = rows.withColumns({name: f(within) for name, f in step.items()})
    cells = rows.groupBy("_key", "_cell").agg(*[c.alias(name) for name, c in totals.items()])
    along = Window.partitionBy("_key").orderBy("_cell")
    for step in before:
        cells = cells.withColumns({name: f(along) for name, f in step.items()})
    return rows.join(cells.drop(*totals), ["_key", "_cell"]).drop("_key", "_cell")


def position(df: DataFrame, name: str) -> Column:
    """A number that doesn't fall where the column doesn't; equal for texts of equal first six bytes. Nulls are least."""
    kind, c = df.schema[name].dataType.simpleString(), F.col(name)
    if kind in ("timestamp", "timestamp_ntz"):
        c = F.unix_micros(c.cast("timestamp"))
    elif kind == "date":
        c = F.unix_date(c)
    elif kind == "string":
        c = F.conv(F.rpad(F.substring(F.hex(F.encode(c, "UTF-8")), 1, 12), 12, "0"), 16, 10)
    elif kind == "boolean":
        c = c.cast("int")
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(float("inf"))), F.lit(float("-inf")))


def quantile_cells(df: DataFrame, first: Column, second: Column, n: int | None = None) -> DataFrame:
    """``df`` with ``_at``, about ``n`` ranges of ``first``; a value that fills several is cut by quantiles of ``second``.

    ``df`` is read once for the quantiles: lists of ``n`` numbers (by default, as many as shuffles have partitions).
    """
    n = n or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / n for i in range(1, n)]
    placed = df.withColumn("_first", first).withColumn("_second", second)
    edges, inner = placed.agg(F.percentile_approx("_first", shares), F.percentile_approx("_second", shares)).first()
    edges, inner = edges or [], inner or []
    heavy = sorted({x for x in edges if edges.count(x) > 1})

    def bucket(df: DataFrame, of: str, to: str, edges: list[float]) -> DataFrame:
        cuts = sorted({x for x in edges if abs(x) != float("inf")})
        if not cuts:
            return df.withColumn(to, F.lit(0.0))
        return Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=of, outputCol=to).transform(df)

    both = bucket(bucket(placed, "_first", "_a", edges), "_second", "_b", inner)
    inside = F.when(F.col("_first").isin(heavy), F.col("_b")).otherwise(float(n)) if heavy else F.lit(float(n))
    return both.withColumn("_at", (F.col("_a") * (n + 1) + inside).cast("long")).drop("_first", "_second", "_a", "_b")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    A session on one machine that names none gets a temporary folder; a cluster must name a shared one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^,\]]+(,\s*\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="attesta-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/attesta-{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once: written to the shared folder, and read from there."""
    path = new_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, by: list[str], score: Column, tie: str, name: str = "rank") -> DataFrame:
    """Rows with their place in ``by``: by greater score, then lesser ``tie``. Null scores come last.

    Rows are computed once, and dealt by quantiles of the score and, where one score fills a cell, of the tie.
    """
    rows = materialised(df.withColumn("_less", -F.coalesce(score.cast("double"), F.lit(float("-inf")))))
    cut = quantile_cells(rows, F.col("_less"), position(rows, tie))
    out = scanned(cut, by, ["_less", tie], F.col("_at"), [{"_own": lambda w: F.row_number().over(w)}], {"_n": F.count("*")}, [{"_off": lambda w: F.coalesce(F.sum("_n").over(past(w)), F.lit(0))}])
    return out.withColumn(name, (F.col("_own") + F.col("_off")).cast("long")).drop("_own", "_off", "_less", "_at")
