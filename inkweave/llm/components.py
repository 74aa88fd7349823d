"""Connected components of an edge table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.session import stage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Tie the neighbours of each node to its least one: those above the node (large star), or those below and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    near = both.join(least, "a")
    tied = near.where(F.col("b") > F.col("a")).select("b", "m") if larger else near.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m"))
    return tied.where(F.col("b") != F.col("m")).select(F.col("m").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (least node of the component) of every node that has an edge (columns a, b; integers)."""
    now, before = stage(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct()), None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if sign == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        before = sign
        now = stage(_star(stage(_star(now, True)), False))
