"""Connected components by alternating stars, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm._common import materialize, release

#: Rounds that no input reaches: their number is of the order of log(nodes) ** 2.
MOST_ROUNDS = 200


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, part)`` for each end of ``links (a, b)``; part is the smallest node of the component.

    Each round connects a node's larger neighbours to its least neighbour, then
    its smaller ones.  Minima are aggregated before they are joined back: a hub's
    side of that join is one row, so its neighbours are never sorted against each
    other and adaptive execution splits them over tasks where they outgrow one.
    Every round is written to the shared folder, which cuts the lineage.  Without
    links no round is planned.
    """
    edges = materialize(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if edges.isEmpty():
        parts = materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("part")), "parts")
        release(edges)
        return parts
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        own = low.select("u", F.col("low").alias("v"))
        rest = large.join(low, "u").filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = materialize(own.union(rest).distinct(), "small-star")
        release(edges, large)
        # Done when each node has one smaller neighbour and that one has none.
        open_ = small.groupBy("u").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("u").union(small.select("v").join(small.select(F.col("u").alias("v")), "v", "left_semi"))
        if open_.isEmpty():
            roots = small.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("part"))
            parts = materialize(small.select(F.col("u").alias("node"), F.col("v").alias("part")).union(roots), "parts")
            release(small)
            return parts
        edges = small
    raise RuntimeError("components did not settle")


def joined_components(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts``, a result of these functions, once ``links (a, b)`` are added; ``parts`` itself where they join nothing.

    Only the links between components are followed, as links of their smallest
    nodes.  Both tables are released once they are not needed.
    """
    if links.isEmpty():
        release(links)
        return parts
    ends = links
    for s in ("a", "b"):
        ends = ends.join(parts.select(F.col("node").alias(s), F.col("part").alias(f"{s}_part")), s, "left")
    between = connected_components(ends.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")))
    release(links)
    if between.isEmpty():
        release(between)
        return parts
    moved = between.select(F.col("node").alias("part"), F.col("part").alias("to"))
    old = parts.join(moved, "part", "left").select("node", F.coalesce("to", "part").alias("part"))
    joined = materialize(old.unionByName(between.join(parts.select("node"), "node", "left_anti")), "parts")
    release(parts, between)
    return joined
