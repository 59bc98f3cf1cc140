"""Halves at the last digit, as SQL rounds doubles."""

import duckdb
from pyspark.sql import functions as F

from corvane.operators import stats


def test_percentiles_that_end_in_a_half(spark):
    papers = spark.range(1, 2001).select(F.col("id").alias("arxiv_id"), (-F.col("id")).cast("double").alias("velocity"), F.lit("x").alias("venue"), F.array(F.lit("a")).alias("category_list"))
    got = {r["arxiv_id"]: r["velocity_percentile"] for r in stats.derive(papers, [F.lit(True)]).collect()}
    want = dict(duckdb.sql("SELECT i, round(100 * (1 - i / CAST(2000 AS DOUBLE)), 1) FROM range(1, 2001) r(i)").fetchall())
    assert got == want
