"""Single linkage against the plain method."""

import numpy as np
import pytest

from corvane.operators import linkage
from corvane.operators import neighbours as N


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")


def plain(m, k=None, distance=None):
    """Merge the two nearest clusters until k are left, or none is within the distance."""
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - np.round(u @ u.T, 12)
    own = np.arange(len(m))
    pairs = sorted((d[i, j], i, j) for i in range(len(m)) for j in range(i + 1, len(m)))
    left = len(m)
    for w, i, j in pairs:
        if (k is not None and left <= k) or (distance is not None and w > distance):
            break
        if own[i] != own[j]:
            own[own == max(own[i], own[j])] = min(own[i], own[j])
            left -= 1
    return own


def numbered(own):
    roots = sorted(set(own))
    return {i: roots.index(o) for i, o in enumerate(own)}


def test_single_linkage_of_500_vectors(spark, monkeypatch):
    for module in (N, linkage):  # many cells and blocks, so that the search outside is pruned
        monkeypatch.setattr(module, "BLOCK_BYTES", 8 * 8 * 30)
    monkeypatch.setattr(N, "CELL_ROWS", 40)
    rng = np.random.default_rng(8)
    m = rng.normal(size=(12, 8))[np.arange(500) % 12] + 0.25 * rng.normal(size=(500, 8))
    m[40:52] = m[3]  # copies
    got = {r["vec_id"]: r["cluster"] for r in linkage.clusters(frame(spark, m), 9).collect()}
    assert got == numbered(plain(m, k=9))


def test_tight_groups_are_looked_up_outside_their_lists(spark):
    # Groups larger than the lists: every list lies inside its own group, so each step between groups needs the search.
    rng = np.random.default_rng(2)
    m = rng.normal(size=(5, 6))[np.arange(200) % 5] + 0.001 * rng.normal(size=(200, 6))
    got = {r["vec_id"]: r["cluster"] for r in linkage.clusters(frame(spark, m), 3).collect()}
    assert got == numbered(plain(m, k=3))
    d = {r["vec_id"]: r["distance"] for r in linkage.centre_distances(frame(spark, m), linkage.clusters(frame(spark, m), 5)).collect()}
    own = plain(m, k=5)
    assert all(d[i] == pytest.approx(np.linalg.norm(m[i] - m[own == own[i]].mean(axis=0))) for i in range(200))


def test_few_and_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["cluster"] for r in linkage.clusters(df, 2).collect()} == {1: 0, 2: 0, 3: 1}
    assert {r["vec_id"]: r["component"] for r in linkage.within(df, 0.5).collect()} == {1: 1, 2: 1, 3: 3}
    assert linkage.clusters(df.limit(0), 2).count() == 0
