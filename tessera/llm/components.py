"""Connected components of a graph that no single machine holds, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """node and component (the smallest node reachable) for every node of an edge other than its component.

    Alternates large stars (each node's larger neighbours go to its least neighbour) and small
    stars (its smaller ones and itself do), each a partial aggregate and a join over edges, until
    nothing changes. Edges never grow in number; nulls and loops are left out.
    """
    now = scratch.save(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    print_of = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.where("u <> v").distinct())
        # every edge now points from the larger node u to a smaller v
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(low.select("u", F.col("m").alias("v")).unionByName(small).distinct())
        scratch.drop(large)
        scratch.drop(now)
        now = new
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == print_of:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        print_of = state
    raise RuntimeError("components did not settle")
