"""The landscape keeps neighbours better than principal components do, and can be repeated."""

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import landscape as L
from corvane.operators import vectors

SF = "/root/testdata/sf0.01"


def trustworthiness(m, y, k=10):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - u @ u.T
    e = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    np.fill_diagonal(e, np.inf)
    rank = np.argsort(np.argsort(d, axis=1), axis=1) + 1
    n, close = len(m), np.argsort(e, axis=1)[:, :k]
    return 1 - 2 * np.maximum(0, np.take_along_axis(rank, close, 1) - k).sum() / (n * k * (2 * n - 3 * k - 1))


def points(df):
    return np.array([(r["x"], r["y"]) for r in df.orderBy("vec_id").collect()])


def test_neighbours_stay_together_and_runs_repeat(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    m = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float)
    got = points(L.landscape(df))
    plain = points(vectors.landscape(df))
    assert trustworthiness(m, got) > trustworthiness(m, plain) + 0.03
    short = [points(L.landscape(df.repartition(n), rounds=2)) for n in (1, 5)]
    assert np.allclose(*short, atol=1e-6)
    box = L.bounds(spark.createDataFrame([(float(x), float(y)) for x, y in got], "x double, y double")).first()
    assert box["n"] == 500 and box["x_min"] == got[:, 0].min() and box["y_max"] == got[:, 1].max()


def test_graph_weights(spark):
    rows = [(i, j, abs(i - j) / 10) for i in range(6) for j in range(6) if i != j and abs(i - j) <= 2]
    got = {(r["a"], r["b"]): r["w"] for r in L.fuzzy_graph(spark.createDataFrame(rows, "id long, other long, distance double"), 4).collect()}
    assert got.keys() == {(i, j) for i, j, _ in rows} and all(abs(got[i, j] - got[j, i]) < 1e-12 and 0 < w <= 1 for (i, j), w in got.items())
    assert got[0, 1] == 1 and got[0, 2] < 1


def test_too_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert L.landscape(df).count() == 0


def test_rounds_without_shuffles_are_those_by_tables(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 64)
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    sc = spark.sparkContext._jsc.sc()
    began = sc.dagScheduler().nextStageId()
    held = points(L.landscape(df, rounds=2))
    now = sc.dagScheduler().nextStageId()
    monkeypatch.setattr(L, "HELD_POINTS", 0)
    assert np.allclose(held, points(L.landscape(df, rounds=2)), atol=1e-6)
    assert now - began < 0.7 * (sc.dagScheduler().nextStageId() - now)


def test_named_vertices_are_those_of_xxhash64(spark):
    ids = [0, 1, 5, 2**40, 1_999_999]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select(*[F.pmod(F.xxhash64("id", F.lit(e), F.lit(j), F.lit(s)), F.lit(n)) for e, j, s, n in ((0, 0, 42, 7), (23, 4, -3, 1_000_003))]).collect()
    want = [L.named(np.array(ids), *x) for x in ((0, 0, 42, 7), (23, 4, -3, 1_000_003))]
    assert [list(r) for r in got] == np.stack(want, axis=1).tolist()
