"""Closures and cycles over edge tables, as loops of joins with a written frontier."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only on one machine a folder of our own stands in
    where none is set; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """edges(a, b) -> all pairs (a, b) with a path from a to b, cycle-safe.

    Doubling: round k knows all pairs up to distance 2^k, each with its distance, and joins only those at
    exactly 2^k with them. A shortest path has one node at that distance, so a pair is found along its shortest
    paths alone, and rounds grow with the logarithm of the longest of these. Stops when no pair is that far
    apart; more rounds than allowed is an error."""
    pairs = settled(edges.where("a is not null and b is not null").select("a", "b").distinct().withColumn("d", F.lit(1)))
    for k in range(most_rounds):
        far = pairs.where(F.col("d") == 1 << k).select("a", F.col("b").alias("via"))
        if far.isEmpty():
            return pairs.select("a", "b")
        step = far.join(pairs.select(F.col("a").alias("via"), "b", (F.col("d") + (1 << k)).alias("d")), "via").select("a", "b", "d")
        pairs = settled(pairs.unionByName(step).groupBy("a", "b").agg(F.min("d").alias("d")))
    raise RuntimeError(f"closure not reached in {most_rounds} rounds")


def core(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """The edges left after removing, again and again, those whose start nothing enters or whose
    end nothing leaves: every cycle, and what lies between cycles."""
    left = settled(edges.select("a", "b").distinct())
    n = left.count()
    for _ in range(most_rounds):
        if not n:
            return left
        ends, starts = left.select(F.col("b").alias("a")).distinct(), left.select(F.col("a").alias("b")).distinct()
        left = settled(left.join(ends, "a", "left_semi").join(starts, "b", "left_semi").select("a", "b"))
        was, n = n, left.count()
        if n == was:
            return left
    raise RuntimeError(f"not peeled in {most_rounds} rounds")


def into_cycles(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Nodes from which a cycle is reached: what is left after removing, again and again, the
    edges whose end nothing leaves. No pairs of nodes are made."""
    left = settled(edges.where("a is not null and b is not null").select("a", "b").distinct())
    n = left.count()
    for _ in range(most_rounds):
        left = settled(left.join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        was, n = n, left.count()
        if n == was:
            return left.select(F.col("a").alias("node")).distinct()
    raise RuntimeError(f"not peeled in {most_rounds} rounds")


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle: the closure is taken of the core alone."""
    return closure(core(edges)).where("a = b").select(F.col("a").alias("node"))


def cycle_chains(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """node, chain: for each node on a cycle a shortest way back to it, as an array that begins
    and ends with it (of equally long ones the smallest)."""
    kept = settled(core(edges))
    paths = kept.select(F.col("a").alias("node"), F.col("b").alias("at"), F.array("a", "b").alias("chain"))
    done, found = None, []
    for _ in range(most_rounds):
        best = settled(paths.groupBy("node", "at").agg(F.min("chain").alias("chain")))
        found.append(best.where("node = at").select("node", "chain"))
        done = best.select("node", "at") if done is None else settled(done.unionByName(best.select("node", "at")))
        finished = done.where("node = at").select("node")
        rest = best.join(finished, "node", "left_anti")
        paths = rest.join(kept, rest["at"] == kept["a"]).select("node", F.col("b").alias("at"), F.concat("chain", F.array("b")).alias("chain"))
        paths = settled(paths.join(done, ["node", "at"], "left_anti"))
        if paths.isEmpty():
            break
    else:
        raise RuntimeError(f"chains not closed in {most_rounds} rounds")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
