"""Connected components of an edge table, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node of the edges (a, b: long).

    Alternates two star contractions: each node's larger neighbours move to its smallest neighbour, then each node's
    smaller ones do. Both are grouped minima and joins on the node, so a node with very many neighbours is summed up before the
    shuffle and Spark may split its join. Ends when nothing changes, in a number of rounds logarithmic in the longest path.
    Each round's edges are written and those of the round before deleted.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    most, state = 2 * now.count(), None  # contractions don't add edges but for one to each node's least neighbour
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.write(large, "edges", most, 16)
        scratch.drop(now)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = scratch.write(now, "edges", most, 16)
        scratch.drop(large)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == state or not mark[0]:
            break
        state = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
