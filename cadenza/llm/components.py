"""Connected components of an edge list, by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so a node with very many edges
is pre-aggregated and its join can be split; nothing is collected but one number
an iteration.  Each iteration is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import discard, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return (
        down.join(low, "a")
        .filter("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(low.select("a", F.col("m").alias("b")))
        .distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and that one has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up + down > 1 AND up > 0").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b) that is not its component's smallest.

    Null ends join nothing, equal and repeated edges count once, and no edges give no rows.
    The result can be given to ``discard``; superseded edges are deleted here.
    """
    edges = written(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        before, edges = edges, written(_small_star(_large_star(edges)), "edges")
        discard(before)
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out.written_path = edges.written_path
    return out
