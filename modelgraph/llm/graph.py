"""Connected components over link tables, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgraph.llm.common import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """links(a, b) -> node, component: the smallest node that each linked node reaches.

    Nodes without a link to another one have no row; null ends, loops and repeated links don't
    matter. Each half of a round joins the links with the smallest neighbour of each node, which
    is written out first, so that the rows of a hub can be split in the join. Rounds grow with
    the logarithm of the longest path. A round's tables are removed when the next one's are
    there; only a flag comes to the driver."""
    tmp = Scratch(links.sparkSession)
    x, y = F.col(a), F.col(b)
    edges = tmp.write(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    for _ in range(most_rounds):
        # Settled: every node is either a centre, or the end of a single link to one.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
        ends = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
        if ends.where("ups > 1 or (ups = 1 and least = 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = tmp.write(both.groupBy("u").agg(F.min("v").alias("m")))
        large = tmp.write(both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        tmp.drop(large)
        small = large.join(tmp.write(large.groupBy("u").agg(F.min("v").alias("m"))), "u")
        edges = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = tmp.write(edges.select("e.*").where("u <> v").distinct())
        tmp.drop(edges)
    raise RuntimeError(f"no components after {most_rounds} rounds")
