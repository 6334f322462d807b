"""Connected components of an edge table, by alternating stars.

Every round hangs each node's larger neighbours, then its smaller ones, under the
least node it knows. Only minima are grouped, so a node with very many edges costs
one partial minimum per task, and the join back has one row per node on one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.scratch import Scratch


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    return row[0], row[1]


def roots(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node`` and ``root``, the least node it is connected with, for every node of
    the edges (``a``, ``b``: longs) that isn't its own root. Loops and repeated edges
    change nothing."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    edges = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        older, edges = edges, scratch.keep(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(older)
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
