"""Ranks by ranges against sorting, and that no task holds a large group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import ranks as R


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = [("hot", float(x)) for x in rng.integers(0, 400, 5000)] + [("small", 3.0), ("ties", 7.0), ("ties", 7.0), ("ties", 7.0), ("ties", None), (None, 1.0), (None, 2.0), ("zero", 0.0)]
    return data, spark.createDataFrame(data, "g string, v double").repartition(7)


def by_group(data):
    out = {}
    for g, v in data:
        out.setdefault(g, []).append(v)
    return {g: sorted(vs, key=lambda v: (v is not None, v or 0)) for g, vs in out.items()}


def test_runs_are_ranks(rows):
    data, df = rows
    got = {}
    for r in R.runs(df, ["g"], "v", 9).collect():
        got.setdefault(r["g"], []).append((r["before"], [r["v"]] * r["n"], r["size"]))
    for g, vs in by_group(data).items():
        runs = sorted(got[g], key=lambda x: x[0])
        assert [v for _, held, _ in runs for v in held] == vs and {s for *_, s in runs} == {len(vs)}
        assert [b for b, *_ in runs] == list(np.cumsum([0, *[len(h) for _, h, _ in runs]])[:-1])


def test_h_index_gini_and_percentiles(rows):
    data, df = rows
    h = {r["g"]: r["h_index"] for r in R.h_index(df, ["g"], "v").collect()}
    gini = {r["g"]: r["gini"] for r in R.gini(df.where("v is not null"), ["g"], "v").collect()}
    some = {r["g"]: r for r in R.runs(df.where("v is not null"), ["g"], "v").groupBy("g").agg(R.percentile("v", 0.75).alias("p"), R.at(F.floor(F.col("size") / 2), "v").alias("m")).collect()}
    for g, vs in by_group(data).items():
        whole = [v for v in vs if v is not None]
        assert h[g] == max([k for k in range(len(whole) + 1) if sum(v >= k for v in whole) >= k])
        x = np.array(whole)
        n = len(x)
        want = 2 * (np.arange(1, n + 1) * x).sum() / (n * x.sum()) - (n + 1) / n if x.sum() else 0
        assert gini[g] == pytest.approx(max(0, want)) and some[g]["p"] == pytest.approx(np.percentile(x, 75)) and some[g]["m"] == x[n // 2]


def test_a_group_of_a_million_is_no_tasks_alone(spark):
    df = spark.range(1_000_000).select(F.lit("one").alias("g"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"))
    held = R.runs(df, ["g"], "v")
    got = held.agg(F.sum("n").alias("n"), F.countDistinct("before").alias("places"), F.max("before").alias("last"), F.corr("before", "v").alias("r")).first()
    assert (got["n"], got["places"], got["last"]) == (1_000_000, 1_000_000, 999_999) and got["r"] > 0.999999
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as on data too large to be put together
    try:
        sizes = held.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum("n").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["n"] for r in sizes) < 300_000 and len(sizes) >= 6  # 64 ranges over eight tasks


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert R.runs(df, ["g"], "v").count() == R.gini(df, ["g"], "v").count() == R.h_index(df, ["g"], "v").count() == 0
