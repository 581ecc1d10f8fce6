"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``(id, component)`` of each node of the edges; ``component`` is the smallest node that it reaches.

    Every round links each node's larger neighbours to its smallest one
    (large star), then its smaller neighbours and itself to the smallest
    (small star), until nothing changes. Rounds grow with the logarithm of a
    component's size. The smallest neighbour is a partial aggregate, and the
    joins have the edges on the left, where a hub's rows can be split. Each
    round is written to the shared folder. Loops and repeated edges do no
    harm; null ends are left out; no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Now every edge goes from a node to a smaller one.
        floor = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(floor, F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, pairs = pairs, cut(small.where("u <> v").distinct())
        forget(before)
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (now["n"], now["h"]):
            break
        state = (now["n"], now["h"])
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
