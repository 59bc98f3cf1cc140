"""Components against a plain search, and how much is written on the way."""

import random

from corvane.operators import graph


def plain(edges):
    near, label = {}, {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for v in sorted(near):
        stack = [] if v in label else [v]
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = v
                stack += near[x]
    return label


def ask(spark, edges, schema="a long, b long"):
    return {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, schema)).collect()}


def test_components_of_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = [(rng.randrange(60), rng.randrange(60)) for _ in range((20, 45, 90)[seed])] + [(7, 7), (1, 2), (2, 1)]
        assert ask(spark, edges) == plain(edges)
    assert ask(spark, [("x", "b"), ("b", "c"), ("p", "q")], "a string, b string") == {"x": "b", "b": "b", "c": "b", "p": "p", "q": "p"}
    assert ask(spark, [(3, 3)]) == {}


def test_a_long_path_writes_few_rows(spark, monkeypatch):
    rows, write = [], graph.written

    def counted(df):
        out = write(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    edges = [(i, i + 1) for i in range(3000)]
    assert set(ask(spark, edges).values()) == {0}
    assert sum(rows) < 8 * len(edges)
