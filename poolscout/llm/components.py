"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of the undirected edges ``(u, v)`` but the roots, where the root is the least node that can
    be reached.

    In turns, every node links its larger neighbours to the least node of its neighbourhood, then its smaller ones. The least
    neighbour comes from an aggregate that combines before its shuffle; in the join back a hub's edges stand against one row, so
    Spark may split them. Each round is a written table; the number of rounds grows with the logarithm of the nodes.
    """
    spark = edges.sparkSession
    smaller = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = saved(smaller, "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # now every row has u > v; link the smaller neighbours of each node to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        following, new_path = saved(small.distinct(), "edges")
        new_mark = _mark(following)
        discard(spark, path)
        now, path = following, new_path
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
