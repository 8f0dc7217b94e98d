"""Connected components of a large graph, in Spark alone.

Random-mate contraction: in each round every vertex points to the neighbour (or
itself) of the smallest hashed priority, and edges are moved to where their ends
point. Priorities change with the round, so even a long chain shrinks by a constant
factor: rounds grow with the logarithm of the largest component. Minima are combined
before the shuffle, so a hub with millions of edges is no hot key in the aggregation;
in the joins AQE splits its partition. Joins are merges, since a broadcast would take
the driver's memory for tables that grow with the graph. Each round's edges and pointers go to the
shared checkpoint folder; the driver sees only whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b; any one comparable type, no nulls): two vertices share a root if a path joins them."""
    left = cut(edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not left.isEmpty():
        salt = F.lit(len(maps))
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.min(F.struct(F.xxhash64(salt, "b").alias("p"), F.col("b").alias("to")))
        own = F.struct(F.xxhash64(salt, "a").alias("p"), F.col("a").alias("to"))
        points = cut(ends.groupBy("a").agg(best.alias("best")).select(F.col("a").alias("v"), F.least(F.col("best"), own)["to"].alias("to")))
        maps.append(points)
        pa, pb = points.select(F.col("v").alias("a"), F.col("to").alias("ta")), points.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        moved = left.join(pa.hint("merge"), "a").join(pb.hint("merge"), "b").filter("ta != tb")
        left = cut(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not maps:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    # follow the pointers from the last round back to the first
    root = maps[-1].select("v", F.col("to").alias("root"))
    for points in reversed(maps[:-1]):
        after = root.select(F.col("v").alias("to"), "root")
        root = points.join(after.hint("merge"), "to", "left").select("v", F.coalesce("root", "to").alias("root"))
    return root
