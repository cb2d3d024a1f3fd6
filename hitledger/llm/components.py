"""Connected components of a graph whose edges are a DataFrame, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitledger.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.join(_least(both).withColumn("least", F.least("a", "least")), "a")
    return joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them; here b < a."""
    joined = edges.join(_least(edges), "a")
    return joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of an edge (a, b) reaches.

    Both steps keep the components and shorten the paths; when nothing changes, every node hangs
    on its root. Edges are rewritten in the shared folder, so that the lineage stays short.
    """
    flat = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    edges = written(flat.distinct(), "edges")
    before, state = None, _state(edges)
    while state[0] and state != before:
        edges = written(_small_star(_large_star(edges)).where("a > b").distinct(), "edges")
        before, state = state, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
