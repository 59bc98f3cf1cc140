"""Exact neighbours, gaps of the embedding space, clusters and landscape against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import neighbours as N


def frame(spark, m, ids=None, kind="long"):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m, strict=True)], f"vec_id {kind}, embedding array<double>")


def brute(m, k):
    """Order and similarity of the k nearest of each row, equal ones by row."""
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = []
    for i in range(len(u)):
        s = np.round(u @ u[i], 12)
        s[i] = -np.inf
        near = np.lexsort((np.arange(len(u)), -s))[:k]
        out.append((near, s[near]))
    return out


def grouped(rng, n, dim, groups, spread):
    centres = rng.normal(size=(groups, dim))
    return centres[np.arange(n) % groups] + spread * rng.normal(size=(n, dim))


def same(found, m, k):
    want = brute(m, k)
    by = {}
    for r in found:
        by.setdefault(r["id"], []).append((-round(1 - r["distance"], 12), r["other"]))
    assert by.keys() == set(range(len(m)))
    for i, (near, s) in enumerate(want):
        got = sorted(by[i])
        assert np.allclose([-x for x, _ in got], s, atol=3e-12)
        if len(set(s)) == k and s.min() > np.sort(np.round((m / np.linalg.norm(m, axis=1, keepdims=True)) @ (m[i] / np.linalg.norm(m[i])), 12))[-k - 2] + 1e-9:
            assert [o for _, o in got] == near.tolist()


@pytest.mark.parametrize("groups,spread", [(1, 1.0), (25, 0.05)])
def test_neighbours_are_the_plain_loop(spark, monkeypatch, groups, spread):
    monkeypatch.setattr(N, "BLOCK_BYTES", 40 * 8 * 12)
    monkeypatch.setattr(N, "CELL_ROWS", 60)
    monkeypatch.setattr(N, "PACK_ROWS", 100)
    monkeypatch.setattr(N, "BLOCKS_A_TASK", 3)
    m = grouped(np.random.default_rng(3), 1500, 12, groups, spread)
    m[100:160] = m[7]  # copies
    m[200] = 3 * m[8]  # the same direction
    same(N.neighbours(frame(spark, m), 6).collect(), m, 6)


def test_cells_are_pruned_without_loss(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_BYTES", 64 * 8 * 100)
    monkeypatch.setattr(N, "CELL_ROWS", 100)
    m = grouped(np.random.default_rng(4), 4000, 64, 40, 0.02)
    index = N.build(frame(spark, m).select(F.col("vec_id").alias("class"), F.col("embedding").alias("v")), 64)
    cells, blocks = len(index.count), index.blocks.count()
    assert cells == 40 and N.candidates(index, 11).count() < 0.5 * cells * blocks
    same(N.neighbours(frame(spark, m), 10).collect(), m, 10)


def test_twenty_thousand_vectors(spark):
    m = grouped(np.random.default_rng(5), 20_000, 16, 300, 0.1).astype(np.float32).astype(float)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.empty((len(u), 10))
    for s in range(0, len(u), 1000):
        sims = u[s : s + 1000] @ u.T
        sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -np.inf
        near[s : s + 1000] = -np.sort(-np.partition(sims, -10, axis=1)[:, -10:], axis=1)
    got = {r["id"]: r["d"] for r in N.neighbours(frame(spark, m), 10).groupBy("id").agg(F.avg("distance").alias("d")).collect()}
    assert np.allclose([got[i] for i in range(len(m))], 1 - near.mean(axis=1), atol=1e-9)


def test_many_copies_are_compared_once(spark):
    m = np.vstack([np.tile([1.0, 2.0, 0.5], (3000, 1)), np.random.default_rng(1).normal(size=(40, 3))])
    rows = N.neighbours(frame(spark, m), 4).collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append((round(r["distance"], 9), r["other"]))
    assert all(len(v) == 4 for v in by.values()) and len(by) == 3040
    for i in (0, 2, 4, 5, 2999):
        assert sorted(by[i]) == [(0.0, j) for j in [x for x in range(6) if x != i][:4]]


def test_rows_without_a_direction(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, 1.0]), ("e", [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), ("f", [float("nan"), 1.0]), ("g", [])]
    got = {}
    for r in N.neighbours(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), 3).collect():
        got.setdefault(r["id"], {})[r["other"]] = r["distance"]
    assert got["a"] == {"d": pytest.approx(1 - 0.5**0.5), "b": None, "c": None}
    assert got["b"] == {"a": None, "c": None, "d": None} and got["e"] == {"a": None, "b": None, "c": None} and None not in got
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert N.neighbours(empty).count() == 0


def test_groups_of_query_blocks(spark, monkeypatch):
    from corvane.operators import neighbours as nb

    rng = np.random.default_rng(12)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(nb, "BLOCK_BYTES", 64 * 6)  # six vectors a block: 50 blocks
    monkeypatch.setattr(nb, "BLOCKS_A_TASK", 7)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    far = 1 - u @ u.T
    np.fill_diagonal(far, np.inf)
    want = {i: sorted(range(300), key=lambda j: far[i, j])[:4] for i in range(300)}
    for groups in (3, 16):
        monkeypatch.setattr(nb, "GROUPS", groups)
        got = {}
        for r in nb.neighbours(df, 4).orderBy("id", "distance").collect():
            got.setdefault(r["id"], []).append(r["other"])
        assert got == want
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= nb.ARROW_BYTES
