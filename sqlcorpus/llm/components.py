"""Connected components of a graph of any size, by stars that shrink towards their smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sqlcorpus.llm.tables import stage


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest reachable node) for every node of ``edges`` (``a``, ``b``, long).

    Each round hangs the larger neighbours of every node on its smallest neighbour, then the
    smaller ones likewise; the rounds end when nothing changes. Minima are folded before the
    shuffle and joined back, so that a node with very many neighbours is never one group.
    Edges with a null end count for nothing; an edge of a node to itself makes a lone node.
    """
    spark = edges.sparkSession
    nodes = edges.where("a is not null and b is not null").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = stage(nodes)
    before = None
    while True:
        links = current.where("u > v")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # larger neighbours go to the smallest neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.*").where("u > v").distinct()
        following = stage(small)
        sign = following.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if tuple(sign) == before:
            break
        before, current = tuple(sign), following
    stars = following
    ends = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return ends.join(stars.select(F.col("u").alias("node"), F.col("v").alias("r")), "node", "left").select(
        "node", F.coalesce("r", "node").alias("root"))
