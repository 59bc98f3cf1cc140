"""Citation trajectories from a long history (arxiv_id, year, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.macros import slope, top


def from_citing(papers: DataFrame, citations: str = "citations") -> DataFrame:
    """The history from each paper's list of citing papers (array of structs with a year)."""
    return papers.select("arxiv_id", F.explode(citations).alias("c")).where("c.year is not null").groupBy("arxiv_id", F.col("c.year").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def cumulative(history: DataFrame) -> DataFrame:
    w = W.partitionBy("arxiv_id").orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    return history.withColumn("cumulative", F.sum("n").over(w))


def velocity(history: DataFrame, now: int, published: DataFrame | None = None) -> DataFrame:
    """Citations a year, recent and early means over two years each, acceleration and its label.

    published: (arxiv_id, pub_year); without it the first cited year counts.
    """
    h = history.join(published, "arxiv_id") if published is not None else history.withColumn("pub_year", F.min("year").over(W.partitionBy("arxiv_id")))
    at = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    out = h.groupBy("arxiv_id", "pub_year").agg(F.sum("n").alias("total"), at(F.col("year").isin(now, now - 1)).alias("r"), at(F.col("year").isin(F.col("pub_year"), F.col("pub_year") + 1)).alias("e"), F.max("year").alias("last"))
    years = F.greatest(F.lit(0.1), (F.lit(now) - F.col("pub_year")).cast("double"))
    out = out.select("arxiv_id", "pub_year", "total", F.round(F.col("total") / years, 2).alias("per_year"), (F.col("r") / 2).alias("recent"), (F.col("e") / 2).alias("early"))
    out = out.withColumn("acceleration", F.col("recent") - F.col("early"))
    label = F.when((F.col("acceleration") > 0.5 * F.col("early")) & (F.col("acceleration") > 1), "accelerating").when((F.col("acceleration") < -0.5 * F.col("early")) & (F.col("acceleration") < -1), "decelerating").otherwise("steady")
    return out.withColumn("trend", label)


def momentum(history: DataFrame, now: int, least: int = 5, n: int = 50, accelerating_only: bool = True) -> DataFrame:
    v = velocity(history, now).where(F.col("total") >= least)
    v = v.where("trend = 'accelerating'") if accelerating_only else v.where("acceleration > 0")
    r = F.when(F.col("early") > 0, F.col("recent") / F.col("early")).otherwise(F.col("recent") + 1)
    return top(v.select("arxiv_id", "total", "acceleration", F.round(F.col("acceleration") * F.log1p(r), 4).alias("score")), n, F.desc("score"), F.asc("arxiv_id"))


def sleeping_beauties(history: DataFrame, now: int, min_age: int = 3, least: int = 20, ratio: float = 3.0) -> DataFrame:
    """Papers whose citations a year, over active years, rose between the halves of their life."""
    h = history.withColumn("p", F.min("year").over(W.partitionBy("arxiv_id")))
    mid = F.col("p") + F.floor((F.lit(now) - F.col("p")) / 2)
    side = lambda cond: F.avg(F.when(cond, F.col("n")))
    out = h.groupBy("arxiv_id", "p").agg(F.sum("n").alias("total"), side(F.col("year") < mid).alias("asleep"), side(F.col("year") >= mid).alias("awake"))
    out = out.where((F.lit(now) - F.col("p") >= min_age) & (F.col("total") >= least) & (F.col("asleep") > 0) & (F.col("awake") / F.col("asleep") >= ratio))
    return out.select("arxiv_id", "total", F.round(F.col("awake") / F.col("asleep"), 4).alias("ratio"), F.round(F.col("awake") / F.col("asleep") * F.log1p("total"), 4).alias("score"))


def declining(history: DataFrame, now: int, min_peak: int = 50, threshold: float = 0.5, before: int = 1) -> DataFrame:
    """Papers well below their peak: mean of the last two years against the mean of three years round the peak."""
    peak = history.groupBy("arxiv_id").agg(F.max_by("year", F.struct("n", -F.col("year"))).alias("peak_year"), F.max("n").alias("peak"), F.count(F.lit(1)).alias("active"))
    h = history.join(peak, "arxiv_id")
    out = h.groupBy("arxiv_id", "peak_year", "peak", "active").agg((F.sum(F.when(F.abs(F.col("year") - F.col("peak_year")) <= 1, F.col("n")).otherwise(0)) / 3).alias("around"), (F.sum(F.when(F.col("year").isin(now, now - 1), F.col("n")).otherwise(0)) / 2).alias("recent"))
    out = out.where((F.col("active") >= 3) & (F.col("peak") >= min_peak) & (F.col("peak_year") < now - before) & (F.col("recent") / F.col("around") < threshold))
    return out.select("arxiv_id", "peak_year", "peak", F.round(F.col("recent") / F.col("around"), 4).alias("ratio"))


def predict(history: DataFrame, now: int, years: int = 2) -> DataFrame:
    """Yearly citations ahead by the slope over active years; with fewer than two, the mean a year."""
    fit = _fit(history)
    out = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(years))))
    per_year = F.col("total") / F.greatest(F.lit(0.1), (F.lit(now) - F.col("p")).cast("double"))
    value = F.when(F.col("k") >= 2, F.greatest(F.lit(0.0), F.round(F.col("last") + F.col("s") * F.col("step")))).otherwise(F.round(per_year)).cast("long")
    out = out.select("arxiv_id", "step", value.alias("predicted"), "total")
    w = W.partitionBy("arxiv_id").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return out.select("arxiv_id", "step", "predicted", (F.col("total") + F.sum("predicted").over(w)).alias("cumulative"))


def _fit(history: DataFrame) -> DataFrame:
    x = history.withColumn("x", F.row_number().over(W.partitionBy("arxiv_id").orderBy("year")) - 1)
    return x.groupBy("arxiv_id").agg(F.count(F.lit(1)).alias("k"), F.round(slope("n"), 4).alias("s"), F.max_by("n", "year").alias("last"), F.sum("n").alias("total"), F.min("year").alias("p"))


def milestones(history: DataFrame, marks: tuple[int, ...] = (10, 50, 100, 500, 1000)) -> DataFrame:
    """First year in which the running total reaches each mark, and the years it took."""
    cum = cumulative(history)
    first = cum.withColumn("p", F.min("year").over(W.partitionBy("arxiv_id")))
    out = first.withColumn("mark", F.explode(F.array(*[F.lit(m) for m in marks]))).where("cumulative >= mark")
    return out.groupBy("arxiv_id", "mark").agg(F.min("year").alias("year"), (F.min("year") - F.min("p")).alias("years_taken"))


def breakouts(papers: DataFrame, share: float = 0.1, least: int = 5, min_citations: int = 10) -> DataFrame:
    """The fastest tenth of each age cohort."""
    age = F.col("paper_age_days") / 365.25
    cohort = F.when(age < 1, "<1").when(age < 2, "1-2").when(age < 3, "2-3").when(age < 5, "3-5").otherwise("5+")
    rows = papers.where(F.coalesce("citations", F.lit(0)) >= min_citations).withColumn("cohort", cohort)
    # A cohort may hold most papers, so its ranks come from a sort over the whole table, counted from each cohort's start.
    from .impact import global_rank

    sizes = rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("size")).withColumn("start", F.coalesce(F.sum("size").over(W.orderBy("cohort").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = global_rank(rows.select("arxiv_id", "cohort", "velocity", "citations"), [F.asc("cohort"), F.desc("velocity"), F.asc("arxiv_id")]).join(F.broadcast(sizes), "cohort")
    out = out.withColumn("place", F.col("rank") - F.col("start")).where((F.col("size") >= least) & (F.col("place") < F.greatest(F.lit(1), F.floor(F.col("size") * share))))
    return out.select("arxiv_id", "cohort", "citations", F.round("velocity", 4).alias("velocity"), (F.col("place") + 1).cast("long").alias("rank"))


def yearly_totals(history: DataFrame) -> DataFrame:
    return history.groupBy("year").agg(F.sum("n").alias("citations"), F.count(F.lit(1)).alias("cited"))
