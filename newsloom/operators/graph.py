"""Connected components."""

from __future__ import annotations

from newsloom.functions.scratch import Scratch
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(a, b)``, of any ordered type: one row ``(id, component)`` for each node with an
    edge, ``component`` being the smallest id that it reaches.

    Alternating large-star and small-star contraction; each half is a minimum per node (combined
    on the map side) and an equi-join whose hot hubs AQE can split. Rounds grow with the logarithm
    of the longest path; each is one job, written. Only counts reach the driver.
    """
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark, written = None, None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        j = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")  # hubs have no rows of their own here
        small = j.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = scratch.save(small.select("e.a", "e.b").where("a <> b").distinct())
        if written is not None:
            scratch.drop(written)
        cur = written = new
        row = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark:
            break
        mark = (row.n, row.h)
    # cur now holds stars: each node once, with its component's smallest id
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
