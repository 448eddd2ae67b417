"""Connected components by alternating large and small stars, each round written down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import table


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node either has one parent and no child, or children only."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = table(large, "large-star")
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    inner = large.join(low, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in links, a written table; the component is the smallest id that can be reached.

    A node with very many links only sends its smallest neighbour, which is
    pre-aggregated; the join back has one row per node on its other side, so a
    skewed node is split at run time. No list of neighbours is gathered.
    """
    links = links.filter(F.col(a) != F.col(b))
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    while not _is_forest_of_stars(edges):
        edges = table(_stars(edges), "stars")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
