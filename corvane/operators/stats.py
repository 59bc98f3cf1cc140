"""Corpus statistics, derived columns, rankings, look-ups and view queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import lexicon as L
from ..functions.macros import rounded, top
from .impact import global_rank

# Words that mark a survey, and venues that count as top.
SURVEY_WORDS = ["survey", "review", "overview", "tutorial", "comprehensive"]


def summary(papers: DataFrame) -> DataFrame:
    """One row of totals, means and coverages."""
    share = lambda f: F.round(F.avg(F.when(f, 100.0).otherwise(0.0)), 4)
    return papers.agg(
        F.count(F.lit(1)).alias("papers"), F.sum(F.coalesce("citations", F.lit(0))).cast("long").alias("citations"), F.round(F.avg(F.coalesce("citations", F.lit(0))), 4).alias("avg_citations"),
        F.max("citations").alias("max_citations"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), share(F.col("has_code")).alias("code_pct"), share(F.col("is_survey")).alias("survey_pct"),
        F.count_distinct("primary_category").alias("categories"),
    )


def grouping_statistics(papers: DataFrame, a: str = "primary_category", b: str = "venue") -> DataFrame:
    """Counts and sums by a, by b and overall from one scan (grouping sets)."""
    rows = papers.select(a, b, F.coalesce("citations", F.lit(0)).alias("y"))
    level = F.when(F.grouping(a) + F.grouping(b) == 2, "all").when(F.grouping(a) == 0, a).otherwise(b)
    return rows.groupingSets([[a], [b], []], a, b).agg(level.alias("level"), F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("citations"))


def dedupe(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def velocity_rank(papers: DataFrame) -> DataFrame:
    """Global rank by velocity from 1 and percentile 100 * (1 - rank / n)."""
    rows = papers.where("velocity is not null").select("arxiv_id", "velocity")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    out = global_rank(rows, [F.desc("velocity"), F.asc("arxiv_id")]).withColumn("rank", F.col("rank") + 1).crossJoin(F.broadcast(n))
    return out.select("arxiv_id", F.col("rank").cast("long").alias("rank"), F.round(100 * (1 - F.col("rank") / F.col("n")), 4).alias("percentile"))


def quality_signals(papers: DataFrame, signals: list[Column]) -> DataFrame:
    total = sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0))
    return papers.select("arxiv_id", total.alias("quality_signals"))


def interdisciplinary(array: str | Column, separator: str = ".") -> Column:
    """Distinct top-level prefixes where there is more than one label, else 0."""
    a = F.col(array) if isinstance(array, str) else array
    n = F.size(F.array_distinct(F.transform(a, lambda x: F.substring_index(x, separator, 1))))
    return F.when(F.size(a) > 1, n).otherwise(0)


def is_survey(title: Column, abstract: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, F.substring(abstract, 1, 200)))
    return F.exists(F.array(*[F.lit(w) for w in SURVEY_WORDS]), lambda w: F.contains(text, w))


def explorer(papers: DataFrame, category: str | None = None, since: str | None = None, until: str | None = None, least: int = 0, most: int | None = None, text: tuple[Column, str] | None = None, order: str = "citations", page: int = 0, size: int = 20) -> DataFrame:
    """One page of a filtered, sorted list."""
    rows = papers
    if category:
        rows = rows.where(F.col("primary_category") == category)
    if since:
        rows = rows.where(F.col("published_date") >= since)
    if until:
        rows = rows.where(F.col("published_date") <= until)
    rows = rows.where(F.coalesce("citations", F.lit(0)) >= least)
    if most is not None:
        rows = rows.where(F.coalesce("citations", F.lit(0)) <= most)
    if text:
        rows = rows.where(F.contains(F.lower(text[0]), F.lit(text[1].lower())))
    return rows.orderBy(F.desc_nulls_last(order), F.asc("arxiv_id")).offset(page * size).limit(size)


def save_ranks(papers: DataFrame, folder: str, order: str = "citations") -> None:
    """All rows with their place in the explorer's order, as files that hold one range of places each."""
    ranked = global_rank(papers, [F.desc_nulls_last(order), F.asc("arxiv_id")])
    ranked.repartitionByRange("rank").sortWithinPartitions("rank").write.mode("overwrite").parquet(folder)


def ranked_page(spark: SparkSession, folder: str, page: int, size: int = 20) -> DataFrame:
    """A page of saved ranks: the files' ranges of places leave all others unread, whatever the page."""
    first = page * size
    return spark.read.parquet(folder).where((F.col("rank") >= first) & (F.col("rank") < first + size)).orderBy("rank").drop("rank")


def page_after(papers: DataFrame, after: tuple | None = None, order: str = "citations", size: int = 20) -> DataFrame:
    """The page after a row (its value of ``order`` and its id; None: the first page): a filter and a top-k, no sort of all rows."""
    rows = papers
    if after is not None:
        value, last = after
        v, tie = F.col(order), F.col("arxiv_id") > F.lit(last)
        rows = rows.where((v.isNull() & tie) if value is None else (v < F.lit(value)) | v.isNull() | ((v == F.lit(value)) & tie))
    return top(rows, size, F.desc_nulls_last(order), F.asc("arxiv_id"))


def top_lists(papers: DataFrame, lists: dict[str, tuple[Column, Column]], n: int = 100) -> DataFrame:
    """Several top lists (name: condition, key) of ids, one below the other."""
    out = None
    for name, (where, key) in lists.items():
        part = top(papers.where(where).select(F.lit(name).alias("list"), "arxiv_id", key.cast("double").alias("key")), n, F.desc("key"), F.asc("arxiv_id"))
        out = part if out is None else out.unionByName(part)
    return out


def compare_categories(papers: DataFrame, a: str, b: str) -> DataFrame:
    rows = papers.where(F.col("primary_category").isin(a, b))
    return rows.groupBy("primary_category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("citations", F.lit(0))), 4).alias("avg_citations"), F.round(F.avg(F.col("has_code").cast("double")), 4).alias("code_rate"))


def histogram(papers: DataFrame, value: str, width: float, bins: int) -> DataFrame:
    """Counts in bins of equal width from 0; the last takes the rest."""
    v = F.least(F.floor(F.col(value) / width), F.lit(bins - 1)).cast("long")
    return papers.where(F.col(value).isNotNull()).groupBy(v.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def derive(papers: DataFrame, signals: list[Column], venue: str = "venue", venues: list[str] | None = None, array: str = "category_list", separator: str = ".") -> DataFrame:
    """Derived columns of every paper: rank and percentile by velocity (none counts as 0), breadth, top venue, quality signals."""
    name = F.lower(F.coalesce(venue, F.lit("")))
    known = F.exists(F.array(*[F.lit(v) for v in venues or L.TOP_VENUES]), lambda v: F.contains(name, v))
    rows = papers.withColumn("is_top_venue", known).withColumn("__v", F.coalesce("velocity", F.lit(0.0)))
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    total = sum((F.coalesce(s, F.lit(False)).cast("int") for s in [*signals, F.col("is_top_venue")]), F.lit(0))
    rows = rows.select("arxiv_id", "__v", F.coalesce(interdisciplinary(array, separator), F.lit(0)).alias("interdisciplinary"), "is_top_venue", total.alias("quality_signals"))
    out = global_rank(rows, [F.desc("__v"), F.asc("arxiv_id")]).crossJoin(F.broadcast(n))  # one row
    return out.select("arxiv_id", (F.col("rank") + 1).cast("long").alias("velocity_rank"), rounded(100 * (1 - (F.col("rank") + 1) / F.col("__n")), 1).alias("velocity_percentile"), "interdisciplinary", "is_top_venue", "quality_signals")


def top_in_category(papers: DataFrame, category, n: int = 15) -> DataFrame:
    rows = papers.where(F.array_contains("category_list", category)).select("arxiv_id", "primary_category", F.coalesce("citations", F.lit(0)).alias("citations"))
    return top(rows, n, F.desc("citations"), F.asc("arxiv_id"))


def search(papers: DataFrame, words: Column, text: str, n: int = 20) -> DataFrame:
    """Papers whose words hold a text, whatever the case, the most cited first."""
    rows = papers.where(F.contains(F.lower(words), F.lit(text.lower()))).select("arxiv_id", F.coalesce("citations", F.lit(0)).alias("citations"))
    return top(rows, n, F.desc("citations"), F.asc("arxiv_id"))


def labelled(papers: DataFrame, names: dict[str, str], key: str = "primary_category", out: str = "category_name") -> DataFrame:
    """With the name of each category; the category itself where it has none."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    return papers.withColumn(out, F.coalesce(F.try_element_at(table, F.col(key)), F.col(key)) if names else F.col(key))


def text_for_vectors(papers: DataFrame, title: str = "title", abstract: str = "abstract", id_column: str = "arxiv_id") -> DataFrame:
    """(id, text): title and abstract as one text; papers without an id get 16 digits of the title's MD5."""
    own = F.coalesce(F.col(id_column).cast("string"), F.substring(F.md5(F.coalesce(title, F.lit("")).cast("binary")), 1, 16))
    return papers.select(own.alias("id"), F.concat_ws(". ", F.nullif(F.coalesce(title, F.lit("")), F.lit("")), F.nullif(F.coalesce(abstract, F.lit("")), F.lit(""))).alias("text"))


def by_category(papers: DataFrame, key: str = "primary_category") -> DataFrame:
    """Papers, mean citations, code rate, mean team and distinct authors of each category."""
    rows = papers.where(F.col(key).isNotNull())
    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("citations", F.lit(0))), 4).alias("avg_citations"), F.round(F.avg(F.col("has_code").cast("double")), 4).alias("code_rate"), F.round(F.avg(F.size(F.coalesce("author_list", F.array()))), 4).alias("avg_team"))
    people = rows.select(key, F.explode("author_list").alias("a")).groupBy(key).agg(F.count_distinct("a").alias("authors"))
    return size.join(people, key, "left").na.fill(0, ["authors"])
