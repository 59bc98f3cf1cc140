"""Pairs inside long lists, and pairs that only their totals admit."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import macros
from corvane.operators import gaps


@pytest.mark.parametrize("block", [1, 2, 3, 7, 256])
def test_pairs_of_lists_of_any_length(spark, block):
    rng = random.Random(block)
    lists = [[rng.choice("abcdefghijklmnopqrst") for _ in range(n)] for n in (0, 1, 2, 3, 6, 7, 8, 20, 60)] + [["x", None, "x", "y"], [None]]
    df = spark.createDataFrame(list(enumerate(lists)) + [(99, None)], "k int, arr array<string>")
    got = sorted((r["k"], r["a"], r["b"]) for r in macros.explode_pairs(df, "arr", keep=("k",), block=block).collect())
    want = sorted((k, a, b) for k, arr in enumerate(lists) for a in set(arr) - {None} for b in set(arr) - {None} if a < b)
    assert got == want


def test_a_list_of_five_thousand_is_dealt_over_tasks(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: F.format_string("a%05d", i)).alias("arr"))
    made = macros.explode_pairs(df, "arr")
    tasks = made.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 5000 * 4999 // 2
    assert max(r["n"] for r in tasks) < 5000 * 4999 // 4 and made.where("a >= b").isEmpty()


def totals(spark, name, values):
    return spark.createDataFrame([(f"{name}{i}", v) for i, v in enumerate(values)], f"{name} string, {name}_total long")


@pytest.mark.parametrize("cell", [2, 1024])
def test_admissible_pairs_are_the_filtered_product(spark, monkeypatch, cell):
    monkeypatch.setattr(gaps, "CELL_ROWS", cell)
    rng = random.Random(4)
    items, cats = [rng.choice([1, 2, 3, 16, 17, 900, 5000, 2**20]) for _ in range(60)], [rng.choice([1, 4, 31, 32, 33, 1000, 1023, 1024]) for _ in range(50)]
    total = spark.createDataFrame([(10_000,)], "total long")
    got = sorted((r["item"], r["cat"]) for r in gaps.admissible(totals(spark, "item", items), totals(spark, "cat", cats), total, 3).collect())
    assert got == sorted((f"item{i}", f"cat{j}") for i, x in enumerate(items) for j, y in enumerate(cats) if x * y / 10_000 > 3)


def test_few_pairs_are_made_of_large_vocabularies(spark, monkeypatch):
    # 3,000 items and 3,000 categories, nearly all rare: nine million pairs, of which a few thousand can be expected often enough.
    sizes = [max(20, 200_000 // (i + 1)) for i in range(3000)]
    total = spark.createDataFrame([(2_000_000,)], "total long")
    item, cat = totals(spark, "item", sizes), totals(spark, "cat", sizes)
    wanted = sum(x * y / 2_000_000 > 3 for x in sizes for y in sizes)
    assert gaps.admissible(item, cat, total, 3).count() == wanted
    assert gaps.admissible(item, cat, total, 0.75).count() < 9_000_000 / 20  # all that the cells' rounding can add: a factor of two for either side


def test_tasks_that_count_pairs_grow_with_the_papers(spark, monkeypatch):
    from collections import Counter
    from itertools import combinations

    from corvane.operators import graph

    monkeypatch.setattr(graph, "TASK_PAPERS", 20)
    teams = [[i % 31, i * 7 % 41 + 100, i * 3 % 17 + 200] for i in range(1000)] + [[5], None]
    df = spark.createDataFrame([(t,) for t in teams], "author_list array<long>")
    made = graph.coauthor_edges(df)
    assert made.rdd.getNumPartitions() == 51
    want = Counter(p for t in teams if t for p in combinations(sorted(set(t)), 2))
    assert {(r["a"], r["b"]): r["w"] for r in made.collect()} == want
