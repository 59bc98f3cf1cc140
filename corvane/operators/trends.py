"""Trends over months: category, method and topic series, forecasts, velocity, saturation, hot and sleeping papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.macros import early, ordinal, r2, ratio, recent, slope, top
from ..functions.ranks import gini


def direction(s: Column, fit: Column, eps: float = 0.1, min_r2: float = 0.2) -> Column:
    return F.when((s > eps) & (fit > min_r2), "increasing").when((s < -eps) & (fit > min_r2), "decreasing").otherwise("stable")


def series(papers: DataFrame, entity: str, array: str | None = None, period: str = "month") -> DataFrame:
    """(entity, period, n): papers of each entity in each period; the entity may come from an array column."""
    rows = papers.where(F.col(period).isNotNull())
    rows = rows.select(F.explode(array).alias(entity), period) if array else rows.select(entity, period)
    return rows.where(F.col(entity).isNotNull()).groupBy(entity, period).agg(F.count(F.lit(1)).alias("n_papers"))


def trend(counts: DataFrame, entity: str, period: str = "month", eps: float = 0.1, min_r2: float = 0.2, up: float = 0.5, down: float = -0.3, min_periods: int = 2) -> DataFrame:
    """Slope, fit, direction, momentum of the last quarter against the first, and status of each entity's series."""
    x = ordinal(counts, [entity], period)
    q = 4
    first = F.sum(F.when(early(F.col("x"), F.col("n"), q), F.col("n_papers")).otherwise(0))
    last = F.sum(F.when(recent(F.col("x"), F.col("n"), q), F.col("n_papers")).otherwise(0))
    out = x.groupBy(entity).agg(F.sum("n_papers").alias("total"), F.count(F.lit(1)).alias("periods"), F.round(slope("n_papers"), 4).alias("slope"), F.round(r2("n_papers"), 4).alias("r2"), first.alias("first"), last.alias("last"))
    momentum = F.when(F.col("periods") >= 4, F.round((F.col("last") - F.col("first")) / F.greatest(F.col("first"), F.lit(1)), 2)).otherwise(0.0)
    out = out.where(F.col("periods") >= min_periods).withColumn("momentum", momentum)
    status = F.when((F.col("momentum") > up) & (F.col("slope") > 0), "emerging").when((F.col("momentum") < down) & (F.col("slope") < 0), "declining").otherwise("stable")
    return out.select(entity, "total", "periods", "slope", "r2", direction(F.col("slope"), F.col("r2"), eps, min_r2).alias("direction"), "momentum", status.alias("status"))


def forecast(counts: DataFrame, entity: str, period: str = "month", ahead: int = 3, least: int = 6) -> DataFrame:
    """Last value plus slope times step, rounded, not below 0, with a confidence from the fit."""
    x = ordinal(counts, [entity], period)
    fit = x.groupBy(entity).agg(slope("n_papers").alias("s"), r2("n_papers").alias("r2"), F.count(F.lit(1)).alias("periods"), F.max_by("n_papers", period).alias("last"))
    fit = fit.where(F.col("periods") >= least)
    out = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    value = F.greatest(F.lit(0.0), F.round(F.col("last") + F.round("s", 4) * F.col("step"))).cast("long")
    confidence = F.when(F.col("r2") < 0.3, "low").when(F.col("r2") < 0.7, "medium").otherwise("high")
    return out.select(entity, "step", value.alias("predicted"), confidence.alias("confidence"))


def growth(counts: DataFrame, entity: str, period: str = "month") -> DataFrame:
    """Percentage by which the second half of the active periods exceeds the first."""
    x = ordinal(counts, [entity], period)
    first = F.sum(F.when(F.col("x") < F.floor(F.col("n") / 2), F.col("n_papers")).otherwise(0))
    out = x.groupBy(entity).agg(first.alias("early"), (F.sum("n_papers") - first).alias("late"))
    return out.where("early > 0").select(entity, "early", "late", F.round((F.col("late") - F.col("early")) / F.col("early") * 100, 1).alias("growth_pct"))


def velocity_by(papers: DataFrame, key: str = "primary_category", least: int = 5) -> DataFrame:
    """Mean and maximum of positive citation velocities, and how many exceed 1."""
    v = papers.where((F.col("velocity") > 0) & F.col(key).isNotNull())
    out = v.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("velocity"), 3).alias("avg_velocity"), F.round(F.max("velocity"), 3).alias("max_velocity"), F.count_if(F.col("velocity") > 1).alias("n_high"))
    return out.where(F.col("n") >= least)


def saturation(papers: DataFrame, key: str = "primary_category", mode: str = "standard") -> DataFrame:
    """Size, mean citations, inequality and slope of each category as one score with a label."""
    rows = papers.where(F.col(key).isNotNull()).withColumn("cites", F.coalesce("citations", F.lit(0)))
    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.avg("cites").alias("avg_c"))
    fit = ordinal(series(rows, key), [key], "month").groupBy(key).agg(F.round(slope("n_papers"), 4).alias("slope"), F.count(F.lit(1)).alias("periods"))
    out = size.join(gini(rows, [key], "cites", mode), key).join(fit.where("periods >= 3"), key)
    score = F.col("total") / 100.0 * 0.3 + (1 - F.col("avg_c") / 100) * 0.3 + F.col("gini") * 0.2 + F.greatest(-F.col("slope"), F.lit(0.0)) * 0.2
    out = out.withColumn("score", score)
    label = F.when(F.col("score") > 0.6, "saturated").when(F.col("score") > 0.4, "competitive").otherwise("opportunity")
    return out.select(key, "total", F.round("avg_c", 4).alias("avg_citations"), F.round("gini", 4).alias("gini"), "slope", F.round("score", 4).alias("score"), label.alias("label"))


def hot(papers: DataFrame, n: int = 50, fast: float = 0.5, young_fast: float = 0.2, young_days: int = 180) -> DataFrame:
    rows = papers.where((F.col("velocity") > fast) | ((F.col("velocity") > young_fast) & (F.col("paper_age_days") < young_days)))
    return top(rows.select("arxiv_id", "primary_category", "citations", F.round("velocity", 4).alias("velocity")), n, F.desc("velocity"), F.asc("arxiv_id"))


def sleeping(papers: DataFrame, n: int = 30, min_age: int = 730, min_velocity: float = 0.3, max_citations: int = 50) -> DataFrame:
    """Old papers of few citations that are cited fast now (snapshot form)."""
    rows = papers.where((F.col("paper_age_days") > min_age) & (F.col("velocity") > min_velocity) & (F.col("citations") < max_citations))
    return top(rows.select("arxiv_id", "citations", "paper_age_days", F.round("velocity", 4).alias("velocity")), n, F.desc("velocity"), F.asc("arxiv_id"))


def quarterly(papers: DataFrame, per: int = 5) -> DataFrame:
    """Papers of each quarter and its leading categories."""
    q = F.concat(F.year("published_date").cast("string"), F.lit("-Q"), F.quarter("published_date").cast("string"))
    counts = papers.withColumn("quarter", q).groupBy("quarter", "primary_category").agg(F.count(F.lit(1)).alias("n"))
    from ..functions.macros import top_per

    return top_per(counts.where("primary_category is not null"), ["quarter"], per, F.desc("n"), F.asc("primary_category"))


def month_matrix(papers: DataFrame, key: str = "primary_category", values: list[str] | None = None) -> DataFrame:
    """Months by categories, 0 where a category has none."""
    rows = papers.where(F.col(key).isNotNull()).groupBy("month")
    return (rows.pivot(key, values) if values else rows.pivot(key)).count().na.fill(0)


def share_of(a: str, b: str) -> Column:
    return F.round(ratio(a, b), 4)


def keyword_trends(papers: DataFrame, array: str = "keywords", period: str = "month", first: int = 5, least: int = 5, min_periods: int = 2, quarter: int = 4) -> DataFrame:
    """Series of each keyword (the first few of a paper): total, slope, first and last period, and whether it is emerging.

    Emerging: first seen in the last quarter of all periods (of fewer than ``quarter`` periods, at any time) and rising.
    """
    rows = papers.where(F.col(period).isNotNull())
    every = rows.select(period).distinct().agg(F.array_sort(F.collect_set(period)).alias("ps"))  # one row for each period of the calendar
    late = F.size("ps") - F.ceil(F.size("ps") / quarter).cast("int") + 1
    cutoff = every.select(F.when(F.size("ps") >= quarter, F.try_element_at("ps", late)).otherwise(F.try_element_at("ps", F.lit(1))).alias("cutoff"))
    counts = series(rows.withColumn("__first", F.slice(array, 1, first)), "keyword", "__first", period)
    out = ordinal(counts, ["keyword"], period).groupBy("keyword").agg(F.sum("n_papers").alias("total"), F.count(F.lit(1)).alias("periods"), F.round(slope("n_papers"), 4).alias("slope"), F.min(period).alias("first_seen"), F.max(period).alias("last_seen"))
    out = out.where((F.col("total") >= least) & (F.col("periods") >= min_periods)).crossJoin(F.broadcast(cutoff))  # one row
    return out.withColumn("emerging", (F.col("first_seen") >= F.col("cutoff")) & (F.col("slope") > 0)).drop("cutoff")


def emerging_keywords(trends: DataFrame, n: int = 30) -> DataFrame:
    return top(trends.where("emerging"), n, F.desc("total"), F.asc("keyword"))


def emerging_words(docs: DataFrame, text: Column, date: str = "published_date", pattern: str = r"\b[a-z]{4,}\b", leading: int = 100, growth: float = 0.5, fresh: int = 10, n: int = 20) -> DataFrame:
    """Of the most frequent words of the last two quarters those that grew over the two before, or are new and frequent.

    Without four quarters: no rows. growth is null for new words, which come first.
    """
    quarter = F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))
    rows = docs.where(F.col(date).isNotNull()).select(quarter.alias("q"), F.lower(text).alias("t"))
    last = rows.select("q").distinct().agg(F.array_sort(F.collect_set("q")).alias("qs")).where("size(qs) >= 4")  # one row, if any
    last = last.select(F.element_at("qs", -2).alias("late"), F.element_at("qs", -4).alias("early"))
    rows = rows.crossJoin(F.broadcast(last)).where("q >= early").select((F.col("q") >= F.col("late")).alias("late"), F.explode(F.regexp_extract_all("t", F.lit(f"({pattern})"), F.lit(1))).alias("word"))
    counts = rows.groupBy("word").agg(F.count_if("late").alias("recent"), F.count_if(~F.col("late")).alias("earlier"))
    out = top(counts.where("recent > 0"), leading, F.desc("recent"), F.asc("word"))
    out = out.withColumn("growth", F.round((F.col("recent") - F.col("earlier")) / F.nullif(F.col("earlier").cast("double"), F.lit(0.0)), 4))
    return top(out.where((F.col("growth") > growth) | (F.col("growth").isNull() & (F.col("recent") >= fresh))), n, F.desc_nulls_first("growth"), F.asc("word"))
