"""Benchmark tables: progression, solved, active and underserved benchmarks, improvements, comparisons, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.macros import top, top_per

BENCH = ["task_name", "dataset_name"]
FULL = [*BENCH, "metric_name"]


def numeric(sota: DataFrame) -> DataFrame:
    """With metric_value as a double; values that are not numbers are null."""
    return sota.withColumn("metric_value", F.expr("try_cast(metric_value as double)"))


def progression(sota: DataFrame, least: int = 2) -> DataFrame:
    """Oldest and latest value of each metric and the improvement."""
    at = F.struct("evaluation_date", "row_id")
    out = numeric(sota).where("metric_value is not null").groupBy(*FULL).agg(F.count(F.lit(1)).alias("n"), F.min_by("metric_value", at).alias("oldest"), F.max_by("metric_value", at).alias("latest"))
    return out.where(F.col("n") >= least).withColumn("improvement", F.col("latest") - F.col("oldest"))


def solved(sota: DataFrame, least: int = 10, plateau: float = 0.01, latest: int = 5, older: int = 10, n: int = 50) -> DataFrame:
    """Benchmarks whose best of the latest values is within a small share of the best before."""
    w = W.partitionBy(*BENCH).orderBy(F.desc("evaluation_date"), F.desc("row_id"))
    r = numeric(sota).where("metric_value is not null").withColumn("rn", F.row_number().over(w))
    best = lambda cond: F.max(F.when(cond, F.col("metric_value")))
    out = r.groupBy(*BENCH).agg(F.count(F.lit(1)).alias("submissions"), best(F.col("rn") <= latest).alias("now"), best((F.col("rn") > latest) & (F.col("rn") <= latest + older)).alias("before"))
    rel = F.abs(F.col("now") - F.col("before")) / F.nullif(F.abs("before"), F.lit(0.0))
    out = out.where(F.col("submissions") >= least).withColumn("change", rel).where(F.col("change") < plateau)
    return top(out.select(*BENCH, "submissions", F.round("change", 6).alias("change")), n, F.desc("submissions"), *[F.asc(c) for c in BENCH])


def active(sota: DataFrame, since: str, least: int = 5) -> DataFrame:
    """Benchmarks with many rows since a date: methods and gain over the best before."""
    fresh = F.col("evaluation_date") >= F.lit(since).cast("timestamp")
    out = numeric(sota).groupBy(*BENCH).agg(F.count_if(fresh).alias("recent"), F.count_distinct(F.when(fresh, F.col("method_name"))).alias("methods"), F.max(F.when(fresh, F.col("metric_value"))).alias("now"), F.max(F.when(~fresh, F.col("metric_value"))).alias("before"))
    gain = (F.col("now") - F.col("before")) / F.nullif(F.abs("before"), F.lit(0.0)) * 100
    return out.where(F.col("recent") >= least).select(*BENCH, "recent", "methods", F.round(gain, 4).alias("improvement_pct"))


def underserved(sota: DataFrame, most: int = 5, min_task: int = 3) -> DataFrame:
    """Benchmarks with few submissions in tasks with many."""
    bench = sota.groupBy(*BENCH).agg(F.count(F.lit(1)).alias("submissions")).where(F.col("submissions") <= most)
    task = sota.groupBy("task_name").agg(F.count(F.lit(1)).alias("task_total")).where(F.col("task_total") >= min_task)
    return bench.join(task, "task_name").withColumn("score", F.round(F.col("task_total") / F.col("submissions"), 4))


def metrics(sota: DataFrame, methods: int = 5) -> DataFrame:
    """Counts, range and dates of each metric, with its most frequent methods."""
    s = numeric(sota)
    out = s.groupBy(*FULL).agg(F.count(F.lit(1)).alias("n"), F.min("metric_value").alias("worst"), F.max("metric_value").alias("best"), F.min("evaluation_date").alias("first"), F.max("evaluation_date").alias("last"))
    counts = s.groupBy(*FULL, "method_name").agg(F.count(F.lit(1)).alias("k"))
    lead = top_per(counts, FULL, methods, F.desc("k"), F.asc("method_name"))
    lead = lead.groupBy(*FULL).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), "method_name"))), lambda x: x["method_name"].cast("string")), ",").alias("dominant"))
    return out.join(lead, FULL)


def improvements(sota: DataFrame) -> DataFrame:
    """Rows that beat all before them, and the days since the one before."""
    w = W.partitionBy(*FULL).orderBy("evaluation_date", "row_id")
    r = numeric(sota).where("metric_value is not null").withColumn("before", F.max("metric_value").over(w.rowsBetween(W.unboundedPreceding, -1)))
    r = r.where("before is null or metric_value > before")
    return r.select(*FULL, "row_id", "metric_value", F.datediff("evaluation_date", F.lag("evaluation_date").over(w)).alias("days"))


def compare_methods(sota: DataFrame, task: str, dataset) -> DataFrame:
    """Best value of each method on a benchmark, ranked for each metric."""
    rows = numeric(sota).where((F.col("task_name") == task) & (F.col("dataset_name") == dataset))
    best = rows.groupBy("metric_name", "method_name").agg(F.max("metric_value").alias("best"), F.count(F.lit(1)).alias("n"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("metric_name").orderBy(F.desc("best"), F.asc("method_name"))))


def gaps(tasks: DataFrame, sota: DataFrame, few: int = 3) -> DataFrame:
    """Tasks with fewer than ``few`` rows, those without any among them."""
    n = sota.groupBy("task_name").agg(F.count(F.lit(1)).alias("n"))
    return tasks.join(n, "task_name", "left").na.fill(0, ["n"]).where(F.col("n") < few)


def ranked(sota: DataFrame) -> DataFrame:
    """Rows with their rank by value on their benchmark and metric; the earlier row first among equals."""
    w = W.partitionBy(*FULL).orderBy(F.desc("metric_value"), "evaluation_date", "row_id")
    return numeric(sota).where("metric_value is not null").withColumn("rank", F.row_number().over(w))


def coverage(evaluations: DataFrame, paper: str = "arxiv_id") -> DataFrame:
    """Evaluations, tasks, data sets and first ranks of each paper that has evaluations (rows with a rank)."""
    e = evaluations.where(F.col(paper).isNotNull())
    return e.groupBy(paper).agg(F.count(F.lit(1)).alias("evaluations"), F.count_distinct("task_name").alias("tasks"), F.count_distinct("dataset_name").alias("datasets"), F.count_if(F.col("rank") == 1).alias("firsts"), F.bool_or(F.coalesce(F.col("rank") == 1, F.lit(False))).alias("is_sota"))


def sota_papers(evaluations: DataFrame, paper: str = "arxiv_id") -> DataFrame:
    """Papers that hold a first rank, or are said to have held one (``was_sota``), with their tasks; the most first."""
    held = F.coalesce(F.col("rank") == 1, F.lit(False))
    ever = held | F.coalesce(F.col("was_sota"), F.lit(False)) if "was_sota" in evaluations.columns else held
    out = evaluations.where(F.col(paper).isNotNull() & ever).groupBy(paper).agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_set("task_name")).alias("tasks"), F.bool_or(held).alias("current"))
    return out.orderBy(F.desc("total"), F.asc(paper))


def leading(evaluations: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Tasks or data sets with most evaluations."""
    return top(evaluations.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")), n, F.desc("n"), F.asc(key))
