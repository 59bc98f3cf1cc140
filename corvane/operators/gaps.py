"""Under-explored combinations and categories: what is rarer than independence would have it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.macros import explode_pairs, top


def pair_gaps(papers: DataFrame, array: str = "category_list", min_expected: float = 5, max_ratio: float = 0.5, min_size: int = 20, n: int = 30) -> DataFrame:
    """Pairs seen together less than chance: expected count1 * count2 / papers, ratio, score."""
    pairs = explode_pairs(papers, array, "cat1", "cat2").groupBy("cat1", "cat2").agg(F.count(F.lit(1)).alias("actual"))
    sizes = papers.select(F.explode(F.array_distinct(array)).alias("cat")).groupBy("cat").agg(F.count(F.lit(1)).alias("size"))
    total = papers.agg(F.count(F.lit(1)).alias("total"))
    out = pairs.join(sizes.select(F.col("cat").alias("cat1"), F.col("size").alias("size1")), "cat1").join(sizes.select(F.col("cat").alias("cat2"), F.col("size").alias("size2")), "cat2").crossJoin(F.broadcast(total))
    out = out.withColumn("e", F.col("size1") * F.col("size2") / F.col("total")).withColumn("r", F.col("actual") / F.col("e"))
    out = out.where((F.col("e") > min_expected) & (F.col("r") < max_ratio) & (F.col("size1") > min_size) & (F.col("size2") > min_size))
    out = out.select("cat1", "cat2", "actual", F.round("e", 1).alias("expected"), F.round("r", 3).alias("ratio"), F.round((1 - F.col("r")) * F.least("e", F.lit(50.0)), 1).alias("score"))
    return top(out, n, F.desc("score"), F.asc("cat1"), F.asc("cat2"))


def prefixes(papers: DataFrame, array: str = "category_list", separator: str = ".", out: str = "prefixes") -> DataFrame:
    """With the distinct top-level prefixes of an array's labels."""
    return papers.withColumn(out, F.array_distinct(F.transform(array, lambda x: F.substring_index(x, separator, 1))))


#: Items, and categories, that meet in one task for one pair of cells.
CELL_ROWS = 1_024


def admissible(item: DataFrame, cat: DataFrame, total: DataFrame, min_expected: float) -> DataFrame:
    """Pairs of (item, item_total) and (cat, cat_total) with item_total * cat_total > min_expected * total, total being one row.

    A range join on a product: categories lie in cells by the power of two of their total; an item looks only into cells that can
    reach the bound, so at most half of the pairs made in its lowest cell are in vain, and all others are wanted. An item of a
    total x has at most x / min_expected partners, as no more categories are that large: the pairs follow the rows, not the product
    of the vocabularies. Full cells are dealt in squares of ``CELL_ROWS``.
    """
    power = lambda c: F.floor(F.log2(c.cast("double"))).cast("int")
    cats = cat.withColumn("cell", power(F.col("cat_total")))
    cells = cats.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # at most 63 rows
    cells = cells.select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("cat_parts"))
    need = F.col("total") * F.lit(float(min_expected)) / F.col("item_total")
    lowest = F.greatest(F.lit(0), power(F.greatest(need, F.lit(1.0))))
    asked = item.crossJoin(F.broadcast(total)).select("item", "item_total", "total", F.explode(F.sequence(lowest, F.lit(62))).alias("cell")).join(F.broadcast(cells), "cell")
    many = F.ceil(F.count(F.lit(1)).cast("double") / CELL_ROWS).cast("int")
    parts = asked.groupBy("cell").agg(many.alias("item_parts"))  # at most 63 rows
    asked = asked.join(F.broadcast(parts), "cell").withColumn("item_part", F.pmod(F.xxhash64("item"), "item_parts").cast("int")).withColumn("cat_part", F.explode(F.sequence(F.lit(0), F.col("cat_parts") - 1)))
    offered = cats.join(F.broadcast(cells), "cell").join(F.broadcast(parts), "cell").withColumn("cat_part", F.pmod(F.xxhash64("cat"), "cat_parts").cast("int")).withColumn("item_part", F.explode(F.sequence(F.lit(0), F.col("item_parts") - 1)))
    met = asked.select("cell", "item_part", "cat_part", "item", "item_total", "total").join(offered.select("cell", "item_part", "cat_part", "cat", "cat_total"), ["cell", "item_part", "cat_part"])
    return met.where(F.col("cat_total") * F.col("item_total") / F.col("total") > min_expected).select("item", "item_total", "cat", "cat_total", "total")


def domain_gaps(papers: DataFrame, items: str = "methods", key: str = "primary_category", min_item: int = 20, min_key: int = 30, min_expected: float = 3, factor: float = 0.3, n: int = 50) -> DataFrame:
    """Items (methods, data sets) used in a category less than their overall rate promises; unseen pairs count as 0.

    Only pairs that chance would have meet more than ``min_expected`` times are made.
    """
    rows = papers.where(F.col(key).isNotNull())
    used = rows.select(F.explode(F.array_distinct(items)).alias("item"), F.col(key).alias("cat"))
    actual = used.groupBy("item", "cat").agg(F.count(F.lit(1)).alias("actual"))
    item = used.groupBy("item").agg(F.count(F.lit(1)).alias("item_total")).where(F.col("item_total") >= min_item)
    cat = rows.groupBy(F.col(key).alias("cat")).agg(F.count(F.lit(1)).alias("cat_total")).where(F.col("cat_total") >= min_key)
    total = papers.agg(F.count(F.lit(1)).alias("total"))
    out = admissible(item, cat, total, min_expected).join(actual, ["item", "cat"], "left").na.fill(0, ["actual"])
    out = out.withColumn("e", F.col("cat_total") * F.col("item_total") / F.col("total")).where(F.col("actual") < factor * F.col("e"))
    return top(out.select("item", "cat", "actual", F.round("e", 1).alias("expected"), F.round(F.col("e") - F.col("actual"), 1).alias("gap")), n, F.desc("gap"), F.asc("item"), F.asc("cat"))


def reproducibility(papers: DataFrame, min_citations: int = 20, n: int = 50) -> DataFrame:
    """Cited papers without code."""
    rows = papers.where((F.coalesce("citations", F.lit(0)) >= min_citations) & ~F.coalesce("has_code", F.lit(False)))
    return top(rows.select("arxiv_id", "primary_category", "citations"), n, F.desc("citations"), F.asc("arxiv_id"))


def code_rate(papers: DataFrame, key: str = "primary_category", least: int = 20) -> DataFrame:
    out = papers.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("has_code").cast("double")), 4).alias("code_rate"))
    return out.where(F.col("n") >= least)


def _shares(papers: DataFrame, key: str, recent_days: int) -> DataFrame:
    age = F.when(F.col("paper_age_days").isNull() | (F.col("paper_age_days") == 0), 365).otherwise(F.col("paper_age_days"))
    rows = papers.where(F.col(key).isNotNull())
    share = lambda flag: F.avg(F.when(flag, 1.0).otherwise(0.0))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_survey")).alias("surveys"), share(F.col("is_survey")).alias("survey_ratio"),
        share(age < recent_days).alias("recency"), share(F.col("has_code")).alias("code"), F.avg(F.coalesce("velocity", F.lit(0.0))).alias("v"), F.avg(F.coalesce("citations", F.lit(0))).alias("avg_c"),
    )


def survey_opportunities(papers: DataFrame, key: str = "primary_category", least: int = 50, max_ratio: float = 0.02, max_surveys: int = 3, recent_days: int = 180) -> DataFrame:
    s = _shares(papers, key, recent_days).where((F.col("n") >= least) & ((F.col("surveys") < max_surveys) | (F.col("survey_ratio") < max_ratio)))
    score = F.col("n") * 0.01 + (1 - F.col("survey_ratio")) * 5 + F.col("recency") * 3
    return s.select(key, "n", "surveys", F.round("survey_ratio", 4).alias("survey_ratio"), F.round(score, 4).alias("score"))


def application_gaps(papers: DataFrame, applied: Column, items: str = "methods", least: int = 20, max_rate: float = 0.15) -> DataFrame:
    """Methods seldom used in papers that apply them."""
    rows = papers.select(F.explode(F.array_distinct(items)).alias("item"), applied.cast("double").alias("applied"))
    out = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("applied"), 4).alias("applied_rate"))
    return out.where((F.col("n") >= least) & (F.col("applied_rate") < max_rate))


def opportunity_scores(papers: DataFrame, key: str = "primary_category", least: int = 20, recent_days: int = 180) -> DataFrame:
    """Five-term score of each category and what it suggests."""
    s = _shares(papers, key, recent_days).where(F.col("n") >= least)
    score = F.least(2 * F.col("v"), F.lit(3.0)) + 2 * F.col("recency") + 2 * (1 - F.col("survey_ratio")) + (1 - F.least(F.col("n") / 500.0, F.lit(1.0))) + F.least(F.col("avg_c") / 20, F.lit(2.0))
    advice = (
        F.when((F.col("v") > 1) & (F.col("survey_ratio") < 0.02), L.OPPORTUNITY_LABELS[0])
        .when((F.col("v") > 0.5) & (F.col("code") < 0.2), L.OPPORTUNITY_LABELS[1])
        .when(F.col("recency") > 0.5, L.OPPORTUNITY_LABELS[2])
        .when((F.col("n") < 100) & (F.col("v") > 0.3), L.OPPORTUNITY_LABELS[3])
        .otherwise(L.OPPORTUNITY_LABELS[4])
    )
    return s.select(key, "n", F.round(score, 4).alias("score"), advice.alias("recommendation"))


def without_survey(papers: DataFrame, key: str = "primary_category", more_than: int = 100) -> DataFrame:
    """Large categories that no survey covers (anti join)."""
    large = papers.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    return large.join(papers.where("is_survey").select(key).distinct(), key, "left_anti")


def hot_low_volume(papers: DataFrame, key: str = "primary_category", fewer_than: int = 50, faster_than: float = 1.0) -> DataFrame:
    """Groups with few papers that gather citations fast, from papers with any velocity."""
    size = papers.where(F.col(key).isNotNull() & (F.col("velocity") > 0)).groupBy(key).agg(F.count(F.lit(1)).alias("papers"), F.avg("velocity").alias("v"))
    return size.where((F.col("papers") < fewer_than) & (F.col("v") > faster_than)).select(key, "papers", F.round("v", 4).alias("avg_velocity"))


def simple_pair_gaps(papers: DataFrame, array: str = "category_list", min_expected: float = 10, factor: float = 0.5, n: int = 15) -> DataFrame:
    """Pairs of labels that meet in fewer papers than chance would have it, by the share that is missing."""
    rows = papers.select(F.array_distinct(array).alias("__labels"))
    size = rows.select(F.explode("__labels").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    met = explode_pairs(rows, "__labels", "cat1", "cat2").groupBy("cat1", "cat2").agg(F.count(F.lit(1)).alias("actual"))
    total = papers.agg(F.count(F.lit(1)).alias("total"))
    out = met.join(size.select(F.col("c").alias("cat1"), F.col("size").alias("s1")), "cat1").join(size.select(F.col("c").alias("cat2"), F.col("size").alias("s2")), "cat2").crossJoin(F.broadcast(total))  # one row
    out = out.withColumn("expected", F.col("s1") * F.col("s2") / F.col("total")).where((F.col("expected") > min_expected) & (F.col("actual") < factor * F.col("expected")))
    return top(out.select("cat1", "cat2", "actual", F.round("expected", 1).alias("expected"), F.round((F.col("expected") - F.col("actual")) / F.col("expected"), 4).alias("score")), n, F.desc("score"), F.asc("cat1"), F.asc("cat2"))


def simple_survey_gaps(papers: DataFrame, survey: Column, key: str = "primary_category", largest: int = 20, more_than: int = 50, rate: float = 0.05, n: int = 10) -> DataFrame:
    """Of the largest categories those with few surveys."""
    size = papers.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(survey).alias("surveys"))
    out = top(size, largest, F.desc("n"), F.asc(key)).where((F.col("n") > more_than) & (F.col("surveys") < rate * F.col("n")))
    return top(out, n, F.desc("n"), F.asc(key))


def view_scores(papers: DataFrame, key: str = "primary_category", least: int = 20, quarter: int = 4) -> DataFrame:
    """The four-term score of the opportunities view: velocity of cited papers, recency over the last quarter of all months, size, citations."""
    months = papers.where("month is not null").select("month").distinct()  # one row for each calendar month
    last = months.agg(F.array_sort(F.collect_set("month")).alias("ms")).select(F.element_at("ms", F.size("ms") - F.ceil(F.size("ms") / quarter).cast("int") + 1).alias("since"))
    y = F.coalesce("citations", F.lit(0))
    rows = papers.where(F.col(key).isNotNull()).crossJoin(F.broadcast(last))  # one row
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(y > 0, F.coalesce("velocity", F.lit(0.0)))), F.lit(0.0)).alias("v"), F.avg(F.when(F.col("month") >= F.col("since"), 1.0).otherwise(0.0)).alias("recency"), F.avg(y).alias("c"))
    score = F.least(2 * F.col("v"), F.lit(3.0)) + 2 * F.col("recency") + (1 - F.least(F.col("n") / 500.0, F.lit(1.0))) + F.least(F.col("c") / 20, F.lit(2.0))
    return out.where(F.col("n") >= least).select(key, "n", F.round(score, 4).alias("score"))


def low_rates(papers: DataFrame, flag: Column, key: str = "primary_category", least: int = 20, rate: float = 0.3, n: int = 15) -> DataFrame:
    """Categories where few papers have something, the lowest shares first."""
    out = papers.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(flag, F.lit(False)).cast("double")), 4).alias("rate"))
    return top(out.where((F.col("n") >= least) & (F.col("rate") < rate)), n, F.asc("rate"), F.asc(key))
