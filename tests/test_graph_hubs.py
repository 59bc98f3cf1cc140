"""Cliques and shortest paths against plain loops on random graphs, and on a vertex with very many neighbours."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from corvane.operators import graph


def table(spark, edges):
    return spark.createDataFrame(sorted(edges), "a long, b long")


def test_cliques_against_all_subsets(spark):
    for seed, share in ((1, 0.5), (2, 0.8)):
        rng = random.Random(seed)
        edges = {p for p in combinations(range(12), 2) if rng.random() < share}
        whole = [set(c) for k in range(3, 13) for c in combinations(range(12), k) if all(p in edges for p in combinations(c, 2))]
        want = sorted(sorted(c) for c in whole if not any(c < o for o in whole))
        assert sorted(r["clique"] for r in graph.maximal_cliques(table(spark, edges)).collect()) == want


def test_a_hub_with_a_hundred_thousand_leaves(spark):
    leaves = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    edges = leaves.unionByName(table(spark, {(1, 2), (2, 3), (1, 3)}))
    assert [r["clique"] for r in graph.maximal_cliques(edges).collect()] == [[0, 1, 2, 3]]
    assert graph.triangles(edges).count() == 4


def test_batches_of_sources_add_up(spark, monkeypatch):
    rng = random.Random(3)
    edges = table(spark, {p for p in combinations(range(14), 2) if rng.random() < 0.3})
    ask = lambda: {r["id"]: round(r["betweenness"], 9) for r in graph.betweenness(edges).collect()}
    once = ask()
    monkeypatch.setattr(graph, "LIVE_PAIRS", 60)
    assert ask() == once and max(once.values()) > 0


def test_strongest_edges(spark):
    rows = [(1, 2, 9), (1, 3, 9), (2, 3, 5), (2, 4, 5), (3, 4, 1), (1, 4, 1)]
    e = spark.createDataFrame(rows, "a long, b long, w long")
    kept = lambda k: sorted(r["w"] for r in graph.strongest(e, k).collect())
    assert kept(1) == [5, 5, 9, 9] and kept(0.5) == [9, 9] and kept(0.1) == [9, 9] and len(kept(2)) == 6
    assert graph.strongest(e.limit(0), 2).count() == 0


def test_pagerank_against_plain_rounds(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(70)})
    df = spark.createDataFrame(edges, "src long, dst long")
    ids = sorted({v for e in edges for v in e})
    out = {v: [b for a, b in edges if a == v] for v in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(20):
        lost = sum(rank[v] for v in ids if not out[v])
        rank = {v: 0.85 * (sum(rank[u] / len(out[u]) for u in ids if v in out[u]) + lost / len(ids)) + 0.15 / len(ids) for v in ids}
    got = {r["id"]: r["pagerank"] for r in graph.pagerank(df).collect()}
    assert set(got) == set(ids) and max(abs(got[v] - rank[v]) for v in ids) < 1e-12
    near = {r["id"]: r["pagerank"] for r in graph.pagerank(df, rounds=50, tol=1e-3).collect()}
    assert max(abs(near[v] - rank[v]) for v in ids) < 0.02 and abs(sum(near.values()) - 1) < 1e-6
    assert graph.pagerank(df.limit(0), rounds=2).count() == 0


def test_triangles_over_every_pair_of_coauthors(spark):
    from corvane.plans import catalog

    sf = "/root/testdata/sf0.001"
    teams = [sorted(set(r["author_list"] or [])) for r in catalog.papers(spark, sf).select("author_list").collect()]
    pairs = {p for t in teams for p in combinations(t, 2)}
    people = sorted({x for p in pairs for x in p})
    want = [c for c in combinations(people, 3) if all(p in pairs for p in combinations(c, 2))]
    assert sorted(tuple(r) for r in catalog.QUERIES["triangles_cliques"](spark, sf).select("a", "b", "c").collect()) == want


def test_triangles_by_colours_against_all_subsets(spark, monkeypatch):
    rng = random.Random(8)
    edges = {p for p in combinations(range(40), 2) if rng.random() < 0.4}
    want = [c for c in combinations(range(40), 3) if all(p in edges for p in combinations(c, 2))]
    for most in (10, 100, 2_000_000):
        monkeypatch.setattr(graph, "TASK_EDGES", most)
        got = graph.triangles(table(spark, edges)).collect()
        assert sorted(tuple(r) for r in got) == want
    named = graph.triangles(table(spark, edges).select(*[F.format_string("v%02d", c).alias(c) for c in "ab"])).collect()
    assert sorted(tuple(int(x[1:]) for x in r) for r in named) == want


def plain_betweenness(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        far, paths, order = {s: 0}, {s: 1}, [s]
        for u in order:
            for v in near[u]:
                if v not in far:
                    far[v], paths[v] = far[u] + 1, 0
                    order.append(v)
                if far[v] == far[u] + 1:
                    paths[v] += paths[u]
        leads = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in near[v]:
                if far[u] == far[v] - 1:
                    leads[u] += paths[u] / paths[v] * (1 + leads[v])
            total[v] += leads[v] if v != s else 0
    n = len(near)
    return {v: x / max(1, (n - 1) * (n - 2)) for v, x in total.items()}


def test_betweenness_takes_every_pair_of_coauthors(spark):
    from corvane.plans import catalog

    sf = "/root/testdata/sf0.001"
    teams = [sorted(set(r["author_list"] or [])) for r in catalog.papers(spark, sf).select("author_list").collect()]
    want = plain_betweenness({p for t in teams for p in combinations(t, 2)})
    got = {r["id"]: r["betweenness"] for r in catalog.QUERIES["betweenness"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-6 for v in want)


def test_betweenness_of_components_by_bits_lists_and_tables(spark, monkeypatch):
    rng = random.Random(11)
    edges = {(a + k * 100, b + k * 100) for k, share in ((0, 0.7), (1, 0.15), (2, 0.08)) for a, b in combinations(range(30), 2) if rng.random() < share}
    edges |= {(1000, 1001), (2000, 2001), (2001, 2002), *((3000 + i, 3001 + i) for i in range(20))}
    want = plain_betweenness(edges)
    df = table(spark, edges | {(5, 5)})
    monkeypatch.setattr(graph, "LIVE_PAIRS", 3_000)
    for name, value in (("HELD_NUMBERS", 50), ("DENSE", 0), ("TASK_WORK", 500), ("HELD_STEPS", 100), ("HELD_STEPS", 0)):
        monkeypatch.setattr(graph, name, value)
        got = {r["id"]: r["betweenness"] for r in graph.betweenness(df).collect()}
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want), name
    some = {r["id"]: round(r["betweenness"], 12) for r in graph.betweenness(df, 15).collect()}
    monkeypatch.setattr(graph, "HELD_STEPS", 8_000_000)
    assert some == {r["id"]: round(r["betweenness"], 12) for r in graph.betweenness(df, 15).collect()} and max(some.values()) > 0


def test_triangles_shuffle_few_bytes_for_an_edge_and_colour(spark, monkeypatch):
    """20 groups of 100 vertices, 99,000 edges that go to 12 colours; some edges twice."""
    monkeypatch.setattr(graph, "TASK_EDGES", 7_000)
    groups = spark.range(2_000).select((F.col("id") % 20).alias("g"), "id")
    edges = graph.written(groups.select("g", F.col("id").alias("a")).join(groups.select("g", F.col("id").alias("b")), "g").where("a < b").select("a", "b"))
    sc = spark.sparkContext._jsc.sc()
    first = sc.dagScheduler().nextStageId()
    assert graph.triangles(edges.unionByName(edges.limit(1_000))).count() == 20 * 161_700
    sc.listenerBus().waitUntilEmpty(30_000)
    sent = sum(sc.statusStore().lastStageAttempt(k).shuffleWriteBytes() for k in range(first, sc.dagScheduler().nextStageId()))
    assert 0 < sent < 4 * 99_000 * 12


def test_packed_numbers_come_back(spark):
    import numpy as np

    ends = np.iinfo(np.int64)
    for a in ([0], [5, 3, 3], [ends.min, ends.max, 0, ends.min], list(range(70_000)), [2**40, -(2**40)]):
        back = graph._unpack(graph._pack(np.array(a, np.int64)) * 2)
        assert [x.tolist() for x in back] == [a, a]
