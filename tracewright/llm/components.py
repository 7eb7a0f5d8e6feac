"""Connected components by alternating large-star and small-star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its smallest neighbour to its larger (large) or its smaller (small) neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.filter("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    told = near.join(least, "a")
    out = told.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else told.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, owner: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Loops and repeated edges do not matter; no edges give no rows. Each round is written to the
    shared folder, so lineage stays short. Rounds grow with the logarithm of the graph.
    """
    sums = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    edges = Scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), owner, "edges")
    last = edges.agg(*sums).first()
    for _ in range(most_rounds):
        if not last["n"]:
            break
        edges = Scratch.write(_star(_star(edges, True), False), owner, "edges")
        now = edges.agg(*sums).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
