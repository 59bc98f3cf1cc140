"""Connected components of a distributed edge list: large-star, small-star rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, rows_of, save


def components(edges: DataFrame) -> DataFrame:
    """(id, component): each vertex of edges (a, b) with the smallest id it reaches. Self-loops and nulls are left out.

    Each round links every vertex to the smallest in its neighbourhood (larger neighbours, then smaller ones), which
    halves paths at least; the edges, not the components, are what is held, so a hub is rows, never one group. Rounds go
    on, as many as it takes, until all that is left are stars around a smallest vertex. A round's table goes when the next
    one stands.
    """
    now = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while rows_of(now) and not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # Small star (repeated edges go at its end): a vertex and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        before, now = now, save(small, "edges")
        forget(before)
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether each larger end stands in one edge alone and none is the smaller end of another."""
    ends = edges.select("a", F.lit(1).alias("larger"), F.lit(0).alias("smaller")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("larger"), F.lit(1).alias("smaller")))
    return ends.groupBy("a").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller")).where("larger + smaller > 1").isEmpty()
