"""Connected components of links by random hooking, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, with_first, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each linked id with the least id that it reaches. Ids without links aren't listed.

    A round lets every label hook to the neighbour of least hash (a new hash each round), flattens the trees by two
    pointer jumps, and contracts the links; a constant share of the labels goes in each, for chains and stars alike.
    Minima are made by partial aggregation, and what a round leaves is written, so lineage stays short.

    Edge cases: null ends and links of an id with itself are dropped; repeated links count once; no links give no rows.
    """
    edges = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    vertices = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("label"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        hooked = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least("m", rank("a"))["to"].alias("to"))
        hooks = tree = written(hooked, "hooks")
        for _ in range(2):
            step = tree.select(F.col("a").alias("to"), F.col("to").alias("next"))
            tree = tree.join(step, "to", "left").select("a", F.coalesce("next", "to").alias("to"))
        tree = written(tree, "trees")
        before = [edges, hooks, tree] + [vertices] * (turn > 1)
        vertices = written(vertices.join(tree.withColumnRenamed("a", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        one = edges.join(tree.withColumnRenamed("to", "x"), "a").select("b", "x")
        edges = written(one.join(tree.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(*before)
    return with_first(vertices, ["label"], "id").select("id", F.col("first").alias("component"))
