"""Agglomerative clusters by single linkage: a minimum spanning tree over exact neighbours, cut at a number of clusters or a distance.

The tree is made in rounds (Boruvka): each cluster so far takes its shortest edge to another one. The lists of nearest neighbours give
most of these edges; only where a vector's whole list lies in its own cluster, and its farthest neighbour is no farther than
the cluster's best edge, the vector is looked up again among the vectors of other clusters, within that bound, in the cell index.
Edges are ordered by distance and ends, so ties give one tree. Copies of a vector are one vertex.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.macros import written
from . import graph
from .neighbours import BLOCK_BYTES, Index, Running, _matrix, _unit, build, chord, nearest, needed_cells

#: Neighbours listed for each vector before the rounds begin.
LISTED = 8


def outside(index: Index, asked: DataFrame, labels: DataFrame) -> DataFrame:
    """(class, other, similarity): of each asked (class, label, bound, v) the nearest vector with another label, if it is within the bound.

    labels: (class, label) of all. bound is a cosine distance, infinite where nothing is known.
    """
    dim, rows = index.dim, max(1, BLOCK_BYTES // (8 * index.dim))
    of = index.blocks.sparkSession.sparkContext.broadcast((index.centres, index.radius, index.count))  # at most MOST_CELLS cells

    def pack(frames):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        known = Index(dim, None, *of.value)
        for f in frames:
            for s in range(0, len(f), rows):
                part = f.iloc[s : s + rows]
                m = _unit(np.array(part["v"].tolist(), "f8").reshape(-1, dim))
                limit = np.sqrt(2 * part["bound"].to_numpy()) + 1e-9
                cells = needed_cells(known, m, limit)
                yield pd.DataFrame({"query": [block], "classes": [part["class"].tolist()], "labels": [part["label"].tolist()], "limit": [limit.tolist()], "m": [m.tobytes()], "cells": [cells.tolist()]})
                block += 1

    tasks = int(index.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    queries = written(asked.repartition(tasks, F.pmod(F.xxhash64("label"), F.lit(4 * tasks)), F.pmod(F.xxhash64("class"), F.lit(4))).sortWithinPartitions("label").mapInPandas(pack, "query long, classes array<long>, labels array<long>, limit array<double>, m binary, cells array<int>"))
    named = index.blocks.select("block", F.posexplode("classes").alias("i", "class")).join(labels, "class")
    named = named.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]).alias("labels"))  # as long as a block
    base = index.blocks.join(named, "block").select("cell", "classes", "labels", "m")
    met = queries.select("query", F.explode("cells").alias("cell")).join(base, "cell").select("query", F.lit(1).alias("kind"), "classes", "labels", F.lit(None).cast("array<double>").alias("limit"), "m")
    both = queries.select("query", F.lit(0).alias("kind"), "classes", "labels", "limit", "m").unionByName(met)

    def work(frames):
        run = None
        for f in frames:
            for kind, classes, names, limit, m in zip(f["kind"], f["classes"], f["labels"], f["limit"], f["m"], strict=True):
                if kind == 0:
                    if run is not None:
                        yield found()
                    run, ids, own, most = Running(_matrix(m, dim), 1), np.asarray(classes), np.asarray(names), np.asarray(limit)

                    def found(run=run, ids=ids):
                        row = np.flatnonzero(run.best[:, 0] > -np.inf)
                        return pd.DataFrame({"class": ids[row], "other": run.at[row, 0], "similarity": run.best[row, 0]})

                    continue
                b, there = _matrix(m, dim), np.asarray(names)
                middle = _unit(b.mean(axis=0, keepdims=True))
                if ((chord(run.q, middle)[:, 0] - chord(b, middle).max()) <= np.minimum(run.bound(), most) + 1e-9).any():
                    run.take(b, np.asarray(classes), lambda s, own=own, there=there: own[:, None] != there[None, s])
        if run is not None:
            yield found()

    ordered = both.repartition("query").sortWithinPartitions("query", "kind")
    return ordered.select("kind", "classes", "labels", "limit", "m").mapInPandas(work, "class long, other long, similarity double")


def spanning_tree(classes: DataFrame, dim: int, listed: int = LISTED) -> DataFrame:
    """(a, b, distance), a < b: the minimum spanning tree of (class, v) by cosine distance."""
    index = build(classes, dim)
    near = written(nearest(index, listed + 1).where("class <> other"))
    # What a list says of the vectors that are not in it: none is nearer. A list of all others says all.
    reach = written(near.groupBy("class").agg(F.max(1 - F.col("similarity")).alias("far"), F.count(F.lit(1)).alias("n")).select("class", F.when(F.col("n") < listed, float("inf")).otherwise(F.col("far")).alias("far")))
    labels, tree = classes.select("class", F.col("class").alias("label")), None
    while True:
        side = labels.select(F.col("class").alias("other"), F.col("label").alias("there"))
        out = near.join(labels, "class").join(side, "other").where("label <> there")
        edge = F.struct((1 - F.col("similarity")).alias("d"), F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b"), "there")
        known = written(out.groupBy("label", "class").agg(F.min(edge).alias("e")))  # a vector's nearest outside, where its list has one
        best = known.groupBy("label").agg(F.min("e").alias("e"))
        doubt = labels.join(known.select("class"), "class", "left_anti").join(reach, "class").join(best.select("label", F.col("e.d").alias("d")), "label", "left")
        doubt = doubt.select("class", "label", "far", F.coalesce("d", F.lit(float("inf"))).alias("bound")).where(F.col("far") <= F.col("bound") + 1e-11)
        asked = written(doubt.where(F.col("far") < float("inf")).join(classes.select("class", "v"), "class"))
        edges = known.select("label", "e")
        if not asked.isEmpty():
            more = outside(index, asked, labels).join(labels, "class").join(side, "other").select("label", edge.alias("e"))
            edges = edges.unionByName(more)
        taken = written(edges.groupBy("label").agg(F.min("e").alias("e")).select("label", "e.*"))
        if taken.isEmpty():
            return tree if tree is not None else near.sparkSession.createDataFrame([], "a long, b long, distance double")
        new = taken.select("a", "b", F.col("d").alias("distance")).dropDuplicates(["a", "b"])
        tree = new if tree is None else tree.unionByName(new)
        merged = graph.components(taken.select(F.col("label").alias("a"), F.col("there").alias("b")))
        labels = written(labels.join(merged.select(F.col("id").alias("label"), "component"), "label").select("class", F.col("component").alias("label")))
        if labels.select("label").distinct().limit(2).count() < 2:
            return tree


def _classes(vectors: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, DataFrame, int]:
    """(id, class) of every row with a direction, (class, v), and the length of the vectors; rows of other lengths are left out."""
    rows = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.where((norm > 0) & (norm < float("inf")) & ~F.isnan(norm))
    usual = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = usual["dim"] if usual else 1
    rows = rows.where(F.size("v") == dim)
    classes = written(rows.groupBy("v").agg(F.min("id").alias("class")))
    return rows.join(classes, "v").select("id", "class"), classes, dim


def _numbered(members: DataFrame, tree: DataFrame, id_column: str) -> DataFrame:
    """Clusters of the remaining tree, numbered by their smallest id."""
    found = graph.components(tree.select("a", "b"))
    own = members.join(found.withColumnRenamed("id", "class"), "class", "left").select("id", F.coalesce("component", "class").alias("root"))
    names = own.select("root").distinct()
    names = names.withColumn("cluster", F.row_number().over(W.orderBy("root")) - 1)  # a row for each cluster
    return own.join(names, "root").select(F.col("id").alias(id_column), "cluster")


def clusters(vectors: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster): the k clusters of single linkage; k is half of the rows where there are fewer than k. Copies share a cluster."""
    members, classes, dim = _classes(vectors, id_column, vector)
    n = members.count()
    k = k if n >= k else max(2, n // 2)
    tree = written(spanning_tree(classes, dim))
    longest = tree.orderBy(F.desc("distance"), F.desc("a"), F.desc("b")).limit(max(0, k - 1))  # as many rows as clusters
    return _numbered(members, tree.join(longest, ["a", "b"], "left_anti"), id_column)


def within(vectors: DataFrame, distance: float, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component): rows that chains of steps of at most a cosine distance connect, by the smallest id of each."""
    members, classes, dim = _classes(vectors, id_column, vector)
    tree = written(spanning_tree(classes, dim)).where(F.col("distance") <= distance)
    found = graph.components(tree.select("a", "b"))
    return members.join(found.withColumnRenamed("id", "class"), "class", "left").select(F.col("id").alias(id_column), F.coalesce("component", "class").alias("component"))


def centre_distances(vectors: DataFrame, clusters: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance): how far each vector is from the mean of its cluster."""
    rows = vectors.select(id_column, vector).join(clusters, id_column)
    flat = rows.select("cluster", F.posexplode(vector).alias("dim", "x"))
    means = flat.groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda z: z["m"]).alias("centre"))  # as long as a vector
    far = F.sqrt(F.aggregate(F.zip_with(vector, "centre", lambda x, c: (x.cast("double") - c) * (x.cast("double") - c)), F.lit(0.0), lambda s, x: s + x))
    return rows.join(centre, "cluster").select(id_column, "cluster", far.alias("distance"))
