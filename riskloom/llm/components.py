"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (src, dst), for every node of an edge.

    Alternates two star contractions until the edge set stops changing: each node hangs its larger
    neighbours, then its smaller ones, on the smallest of them. The number of rounds grows with the
    logarithm of the component size. Minima are aggregated before they are shuffled, and stored before they are
    joined: a join with a stored table shuffles both sides anew (or broadcasts the small one), so Spark can
    split the rows of a hub, and a star of any size never sits in one task.
    """
    state = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        small_low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(small_low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_low.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        state = cut(small)
        mark = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(u, v) % 1000003 as bigint))")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
