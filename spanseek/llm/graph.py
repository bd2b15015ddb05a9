"""Connected components of an edge table by alternating star contractions, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanseek.session import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges``: a, b (any orderable type). Returns node, label for every node of an edge; the label is the least node of its component.

    Each round hangs every node's larger neighbours on its least neighbour, then its smaller ones and itself. Every edge then joins a node to a
    smaller one, and the table ends as stars around the least nodes. A node with very many edges is only ever the key of a minimum, which is
    taken in part before the shuffle, and of a join, whose large keys are split at run time.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large)
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(below.select("a", F.col("m").alias("b")))
        now = written(small.distinct())
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
