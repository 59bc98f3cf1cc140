"""Authors: roll-ups, rankings, timelines, momentum, topics, careers, collaborators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.macros import ordinal, slope, top, top_per
from ..functions.ranks import h_index
from . import graph


def authorships(papers: DataFrame, array: str = "author_list") -> DataFrame:
    """(author, position, arxiv_id, year, category, citations, velocity, category_list): one row for each author of a paper."""
    rows = papers.select("*", F.posexplode(F.array_distinct(array)).alias("position", "author"))
    return rows.select("author", "position", "arxiv_id", "year", "primary_category", "category_list", F.coalesce("citations", F.lit(0)).alias("y"), F.coalesce("velocity", F.lit(0.0)).alias("v"))


def coauthors(papers: DataFrame, array: str = "author_list") -> DataFrame:
    """(author, other, arxiv_id, year): both directions, within a paper."""
    rows = papers.select("arxiv_id", "year", F.array_distinct(array).alias("arr")).select("arxiv_id", "year", "arr", F.explode("arr").alias("author"))
    return rows.select("arxiv_id", "year", "author", F.explode("arr").alias("other")).where("author <> other")


def rollup(papers: DataFrame) -> DataFrame:
    """Papers, first authorships, citations, categories and collaborators of each author."""
    a = authorships(papers)
    own = a.groupBy("author").agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.col("position") == 0).alias("first_author"), F.sum("y").cast("long").alias("citations"), F.count_distinct("primary_category").alias("categories"))
    others = coauthors(papers).groupBy("author").agg(F.count_distinct("other").alias("collaborators"))
    return own.join(others, "author", "left").na.fill(0, ["collaborators"])


def modal(a: DataFrame, key: str = "primary_category") -> DataFrame:
    """Each author's most frequent category; ties: the smallest."""
    counts = a.where(F.col(key).isNotNull()).groupBy("author", key).agg(F.count(F.lit(1)).alias("k"))
    return top_per(counts, ["author"], 1, F.desc("k"), F.asc(key)).select("author", F.col(key).alias("main_category"))


def prolific(papers: DataFrame, least: int = 3) -> DataFrame:
    a = authorships(papers)
    out = a.groupBy("author").agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.col("position") == 0).alias("first"), F.min("year").alias("y0"), F.max("year").alias("y1"))
    out = out.where(F.col("papers") >= least).join(modal(a), "author", "left")
    return out.select("author", "papers", "main_category", F.round(F.col("first") * 100.0 / F.col("papers"), 1).alias("first_author_rate"), (F.col("y1") - F.col("y0") + 1).alias("span"), F.round(F.col("papers") / (F.col("y1") - F.col("y0") + 1), 4).alias("papers_per_year"))


def influential(papers: DataFrame, n: int = 50) -> DataFrame:
    """By 2 ln(1 + citations) + 1.5 ln(1 + papers) + 0.5 ln(1 + coauthors)."""
    r = rollup(papers)
    score = 2 * F.log1p("citations") + 1.5 * F.log1p("papers") + 0.5 * F.log1p("collaborators")
    return top(r.select("author", "papers", "citations", "collaborators", F.round(score, 4).alias("score")), n, F.desc("score"), F.asc("author"))


def influential_h(papers: DataFrame, n: int = 50, least: int = 2) -> DataFrame:
    """By 2 ln(1 + citations) + 3 h + 10 mean velocity + 0.5 ln(1 + coauthors)."""
    a = authorships(papers)
    own = a.groupBy("author").agg(F.count(F.lit(1)).alias("papers"), F.sum("y").cast("long").alias("citations"), F.avg("v").alias("v")).where(F.col("papers") >= least)
    others = coauthors(papers).groupBy("author").agg(F.count_distinct("other").alias("co"))
    out = own.join(h_index(a, ["author"], "y"), "author").join(others, "author", "left").na.fill(0, ["co"])
    score = 2 * F.log1p("citations") + 3 * F.col("h_index") + 10 * F.col("v") + 0.5 * F.log1p("co")
    return top(out.select("author", "papers", "citations", "h_index", F.round(score, 4).alias("score"), F.round(F.col("citations") / F.greatest("co", F.lit(1)), 4).alias("citations_per_coauthor")), n, F.desc("score"), F.asc("author"))


def rising(papers: DataFrame, now: int, n: int = 50, least: int = 3, most: int = 50, career: int = 8) -> DataFrame:
    a = authorships(papers)
    fresh = F.col("year") >= now - 2
    out = a.groupBy("author").agg(F.count(F.lit(1)).alias("papers"), (F.lit(now) - F.min("year") + 1).alias("career"), F.sum("y").cast("long").alias("citations"), F.avg("y").alias("avg"), F.count_if(fresh).alias("recent"), F.avg(F.when(fresh, F.col("y"))).alias("recent_avg"), F.sum(F.when(fresh, F.col("v")).otherwise(0.0)).alias("v"))
    out = out.where(F.col("papers").between(least, most) & (F.col("career") <= career) & (F.col("recent") >= 1))
    score = 2 * F.least(F.col("v") / 5, F.lit(2.0)) + 1.5 * (F.col("recent_avg") / F.greatest("avg", F.lit(1.0))) + (1 + 0.1 * (career - F.col("career"))) + 0.5 * F.log1p("citations")
    return top(out.select("author", "papers", "career", "citations", F.round(score, 4).alias("score")), n, F.desc("score"), F.asc("author"))


def collaborators(papers: DataFrame, interests: dict[str, Column], exclude: list | None = None, n: int = 50) -> DataFrame:
    """Authors whose papers match the interests (name: condition on a paper), by coverage, relevance and impact."""
    k = len(interests)
    hits = F.filter(F.array(*[F.when(v, F.lit(name)) for name, v in interests.items()]), lambda x: x.isNotNull())
    rows = papers.withColumn("hits", hits).where(F.size("hits") > 0)
    a = rows.select("hits", F.coalesce("citations", F.lit(0)).alias("y"), F.explode(F.array_distinct("author_list")).alias("author"))
    if exclude:
        a = a.where(~F.col("author").isin(exclude))
    out = a.groupBy("author").agg(F.count(F.lit(1)).alias("papers"), F.sum("y").cast("long").alias("citations"), (F.size(F.array_distinct(F.flatten(F.collect_set("hits")))) / F.lit(float(k))).alias("coverage"), F.avg(F.size("hits") / F.lit(float(k))).alias("relevance"))
    score = 3 * F.col("coverage") + 2 * F.col("relevance") + 0.5 * F.log1p("citations") + 0.5 * F.log1p("papers")
    return top(out.select("author", "papers", "citations", F.round("coverage", 4).alias("coverage"), F.round(score, 4).alias("score")), n, F.desc("score"), F.asc("author"))


def timeline(papers: DataFrame) -> DataFrame:
    """Papers and citations of each author and year."""
    return authorships(papers).groupBy("author", "year").agg(F.count(F.lit(1)).alias("papers"), F.sum("y").cast("long").alias("citations"))


def timeline_trend(papers: DataFrame) -> DataFrame:
    """Slope of the yearly papers, peak year (the first), and active years of each author."""
    x = ordinal(timeline(papers), ["author"], "year")
    out = x.groupBy("author").agg(F.round(slope("papers"), 4).alias("slope"), F.count(F.lit(1)).alias("active_years"), F.max_by("year", F.struct("papers", -F.col("year"))).alias("peak_year"))
    trend = F.when(F.col("active_years") < 2, "insufficient_data").when(F.col("slope") > 0.5, "increasing").when(F.col("slope") < -0.5, "decreasing").otherwise("stable")
    return out.withColumn("trend", trend)


def momentum(papers: DataFrame, least: int = 3) -> DataFrame:
    """Rates of the second half of the active years against the first, papers and citations blended 0.4 and 0.6."""
    x = ordinal(timeline(papers), ["author"], "year")
    first = F.col("x") < F.floor(F.col("n") / 2)
    rate = lambda col, flag: F.avg(F.when(flag, F.col(col)))
    out = x.groupBy("author").agg(F.count(F.lit(1)).alias("years"), rate("papers", first).alias("p0"), rate("papers", ~first).alias("p1"), rate("citations", first).alias("c0"), rate("citations", ~first).alias("c1")).where(F.col("years") >= least)
    change = lambda a, b: (F.col(b) - F.col(a)) / F.greatest(F.col(a), F.lit(1.0))
    out = out.withColumn("m", 0.4 * change("p0", "p1") + 0.6 * change("c0", "c1"))
    label = F.when(F.col("m") > 0.3, "accelerating").when(F.col("m") < -0.3, "decelerating").otherwise("steady")
    return out.select("author", "years", F.round("m", 4).alias("momentum"), label.alias("label"))


def topics(papers: DataFrame, array: str = "category_list", factor: float = 2, least: int = 2) -> DataFrame:
    """Topics that emerged or faded between the first and last third of an author's active years."""
    rows = papers.select("year", array, F.explode(F.array_distinct("author_list")).alias("author"))
    rows = rows.withColumn("yr", F.dense_rank().over(W.partitionBy("author").orderBy("year")) - 1)
    years = rows.groupBy("author").agg((F.max("yr") + 1).alias("n"))
    t = rows.join(years, "author").where("n >= 3").select("author", "yr", "n", F.explode(F.array_distinct(array)).alias("topic"))
    early, late = F.count_if(F.col("yr") < F.floor(F.col("n") / 3)), F.count_if(F.col("yr") >= F.col("n") - F.ceil(F.col("n") / 3))
    out = t.groupBy("author", "topic").agg(early.alias("early"), late.alias("late"))
    change = F.when((F.col("late") > factor * F.col("early")) & (F.col("late") >= least), "emerged").when((F.col("early") > factor * F.col("late")) & (F.col("early") >= least), "faded")
    return out.withColumn("change", change).where("change is not null")


def migration(papers: DataFrame, now: int, array: str = "category_list", least: int = 2, current: int = 2) -> DataFrame:
    """Topics that an author worked on in several years: first, last and active years, and whether the last is at most ``current`` years ago."""
    rows = papers.where("year is not null").select("year", array, F.explode(F.array_distinct("author_list")).alias("author")).select("author", "year", F.explode(F.array_distinct(array)).alias("topic")).distinct()
    out = rows.groupBy("author", "topic").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("active_years"))
    return out.where(F.col("active_years") >= least).withColumn("is_current", F.col("last_year") >= now - current)


def careers(papers: DataFrame, now: int) -> DataFrame:
    """Career stage by length and impact level by h-index."""
    a = authorships(papers)
    out = a.groupBy("author").agg((F.lit(now) - F.min("year") + 1).alias("length")).join(h_index(a, ["author"], "y"), "author")
    stage = F.when(F.col("length") <= 5, "early_career").when(F.col("length") <= 12, "mid_career").when(F.col("length") <= 20, "senior").otherwise("established")
    level = F.when(F.col("h_index") >= 50, "high").when(F.col("h_index") >= 20, "significant").when(F.col("h_index") >= 10, "moderate").otherwise("emerging")
    return out.select("author", "length", "h_index", stage.alias("stage"), level.alias("impact"))


def cumulative_coauthors(papers: DataFrame) -> DataFrame:
    """New co-authors of each author and year, and their running number."""
    first = coauthors(papers).groupBy("author", "other").agg(F.min("year").alias("year"))
    per = first.groupBy("author", "year").agg(F.count(F.lit(1)).alias("truly_new"))
    return per.withColumn("cumulative", F.sum("truly_new").over(W.partitionBy("author").orderBy("year").rowsBetween(W.unboundedPreceding, 0)))


def citation_growth(papers: DataFrame, last: int = 3, up: float = 1.2, down: float = 0.8) -> DataFrame:
    """Mean citations a year over an author's last active years against all of them."""
    x = ordinal(timeline(papers), ["author"], "year")
    out = x.groupBy("author").agg(F.count(F.lit(1)).alias("years"), F.sum("citations").alias("citations"), F.avg("citations").alias("overall"), F.avg(F.when(F.col("x") >= F.col("n") - last, F.col("citations"))).alias("recent"))
    label = F.when(F.col("recent") > up * F.col("overall"), "accelerating").when(F.col("recent") < down * F.col("overall"), "decelerating").otherwise("steady")
    return out.select("author", "years", "citations", F.round("overall", 4).alias("overall"), F.round("recent", 4).alias("recent"), label.alias("trend"))


def collaboration_patterns(papers: DataFrame) -> DataFrame:
    """Papers, solo share, distinct co-authors and co-authorships a paper of each author; in joint papers the author counts, too."""
    rows = papers.select("arxiv_id", F.array_distinct("author_list").alias("arr")).select("arxiv_id", "arr", F.explode("arr").alias("author"))
    own = rows.groupBy("author").agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.size("arr") <= 1).alias("solo"), F.sum(F.when(F.size("arr") > 1, F.size("arr")).otherwise(0)).alias("met"))
    others = rows.where("size(arr) > 1").select("author", F.explode("arr").alias("other")).groupBy("author").agg(F.count_distinct("other").alias("coauthors"))
    out = own.join(others, "author", "left").na.fill(0, ["coauthors"])
    return out.select("author", "papers", "solo", F.round(F.col("solo") * 100.0 / F.col("papers"), 1).alias("solo_rate"), "coauthors", F.round(F.col("met") / F.col("papers"), 2).alias("coauthors_per_paper"))


def closest(papers: DataFrame, n: int = 10) -> DataFrame:
    """The authors with whom each author shares most papers."""
    met = coauthors(papers).groupBy("author", "other").agg(F.count(F.lit(1)).alias("papers"))
    return top_per(met, ["author"], n, F.desc("papers"), F.asc("other"))


def index_summary(papers: DataFrame) -> DataFrame:
    """One row: authors, their papers on average and at most, those with several papers."""
    own = authorships(papers).groupBy("author").agg(F.count(F.lit(1)).alias("k"))
    return own.agg(F.count(F.lit(1)).alias("authors"), F.round(F.avg("k"), 4).alias("avg_papers"), F.max("k").alias("max_papers"), F.count_if(F.col("k") > 1).alias("with_several"))


def top_pairs(papers: DataFrame, n: int = 20) -> DataFrame:
    """Pairs of authors with most shared papers."""
    return top(graph.coauthor_edges(papers).withColumnRenamed("w", "papers"), n, F.desc("papers"), F.asc("a"), F.asc("b"))


def best_h(papers: DataFrame) -> DataFrame:
    """(arxiv_id, max_h): the highest h-index among a paper's authors, inside the corpus."""
    a = authorships(papers)
    return a.join(h_index(a, ["author"], "y"), "author").groupBy("arxiv_id").agg(F.max("h_index").alias("max_h"))


def profile(papers: DataFrame, author) -> dict[str, DataFrame]:
    """All that is known of one author, as lazy tables over the papers of theirs alone."""
    own = papers.where(F.array_contains("author_list", author))
    only = lambda df: df.where(F.col("author") == author)
    return {"timeline": only(timeline(own)), "trend": only(timeline_trend(own)), "growth": only(citation_growth(own)), "topics": only(topics(own)), "momentum": only(momentum(own)), "collaboration": only(collaboration_patterns(own)), "closest": only(closest(own)), "breadth": only(cumulative_coauthors(own))}
