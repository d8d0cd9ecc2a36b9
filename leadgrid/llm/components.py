"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgrid.llm import skew
from leadgrid.sources.storage import stored


def _to_least(rows: DataFrame, own: bool) -> DataFrame:
    """Each row (u, v): v now points to the least of u's neighbours; with `own`, u does too, else the least may be u."""
    least = stored(rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")), "stars")
    joined = skew.join_groups(rows, least, ["u"], "size")
    if own:  # all v are below u
        links = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    else:  # v above u goes to the least of u and its neighbours
        links = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
    return links.filter(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the least node that it can reach.

    Edges between a node and itself are left out; an empty table gives an empty one. Each step writes its edges to the
    shared folder, so lineage stays short. Fails if the edges still change after `rounds` rounds.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(),
        "edges",
    )
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_to_least(both, own=False), "large-star")
        edges = stored(_to_least(large.select(F.col("a").alias("u"), F.col("b").alias("v")), own=True), "small-star")
        # a star's edges stay as they are, so equal sums over the edges mean that nothing changed
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select("root").distinct().select(F.col("root").alias("node"), "root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
