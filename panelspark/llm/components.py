"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so a node with very many links is counted within
tasks first and its join partition is split by adaptive execution. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import settle


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour to the least node around."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionAll(least.select("u", F.col("m").alias("v"))).distinct()
    )


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node hangs on one other node, which hangs on none."""
    row = edges.agg(F.count("*").alias("edges"), F.count_distinct("u").alias("nodes")).first()
    return row.edges == row.nodes and edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links(a, b)``; the component is its least node.

    Links of a node to itself are ignored. An empty table gives an empty result.
    """
    edges = settle(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    while not _is_forest_of_stars(edges):
        edges = settle(_small_star(_large_star(edges)), "links")
    return (
        edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    )


def joined_components(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of the links behind ``found`` and further ``links``: only components that these join are worked on."""
    if found is None:
        return settle(components(links), "components")
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias("c" + side))
    raised = (
        links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    )
    raised = settle(raised, "raised-links")
    if raised.isEmpty():
        return found
    merged = components(raised)
    moved = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    moved = moved.select("node", F.coalesce("into", "component").alias("component"))
    return settle(moved.unionAll(merged).distinct(), "components")
