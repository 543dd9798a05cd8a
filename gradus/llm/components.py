"""Connected components of a graph that is kept as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.store import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the smallest node that ``node`` reaches, for each node of an edge. Nulls have no edges.

    Large star and small star in turn: every node's larger neighbours, then its smaller ones, are tied to the smallest node in sight,
    until no edge changes; the rounds grow with the logarithm of the longest path. A node's smallest neighbour is an aggregate that is
    combined before the shuffle, so that a hub with a third of all edges is spread; joins on it are left to skew handling."""
    own = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = settle(own.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        before = _mark(now)
        now = settle(_small(_large(now)))
        if _mark(now) == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    """What tells one set of edges from another: their number and a hash sum."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the node's smallest neighbour or itself."""
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))  # u > v: v's larger neighbours
    return larger.join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours and the node itself are tied to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(low.select("u", F.col("m").alias("v"))).distinct()
