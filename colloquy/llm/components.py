"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``.

    The component is the smallest node reachable. Large-star and small-star steps alternate
    (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) until every node
    points at its component's smallest node; each round is written to the shared folder, so a
    lost executor costs one round at most. Links stay distributed throughout.
    """
    state = written(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u")
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        state = written(small, "links")
        # done when no node has two targets and no target points on
        twice = state.groupBy("u").count().filter("count > 1").select("u")
        onward = state.join(state.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if twice.unionByName(onward).isEmpty():
            break
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
