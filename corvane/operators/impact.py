"""What goes with being cited: lifts, quartiles, buckets, the success formula and scores after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.macros import bucket, cut, lift, upper_median
from ..functions.ranks import at, percentile, runs

def cites() -> Column:
    return F.coalesce(F.col("citations"), F.lit(0)).cast("double")


def binary_lifts(papers: DataFrame, flags: list[str]) -> DataFrame:
    """Lift of the mean citations for each flag, from one scan."""
    long = papers.select(cites().alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(f, F.lit(False)).alias("on")) for f in flags])).alias("s")).select("y", "s.feature", "s.on")
    out = long.groupBy("feature").agg(F.count_if("on").alias("n_with"), F.count_if(~F.col("on")).alias("n_without"), F.round(lift(F.col("y"), F.col("on")), 2).alias("lift"))
    impact = F.when(F.col("lift") > 1.2, "positive").when(F.col("lift") < 0.8, "negative").otherwise("neutral")
    return out.where("n_with > 0 and n_without > 0").select("feature", "n_with", "n_without", "lift", impact.alias("impact"))


def words(text: str | Column) -> Column:
    """Words between white space; none for null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(F.coalesce(t, F.lit("")), r"[\x09-\x0D\x20]+"), lambda w: w != ""))


#: Labels of abstracts by their words, with the most words of each.
ABSTRACT_BUCKETS = [(99, "short (<100 words)"), (199, "medium (100-200)"), (299, "long (200-300)")]


def title_traits(papers: DataFrame, title: str = "title", short: int = 8) -> DataFrame:
    """Mean citations with and without a colon, a question mark and at most ``short`` words in the title; traits on one side only are left out."""
    t = F.coalesce(F.col(title), F.lit(""))
    traits = {"has_colon": F.contains(t, F.lit(":")), "has_question": F.contains(t, F.lit("?")), "short_title": words(t) <= short}
    long = papers.select(cites().alias("y"), F.explode(F.array(*[F.struct(F.lit(k).alias("trait"), on.alias("on")) for k, on in traits.items()])).alias("s")).select("y", "s.*")
    side = lambda on: F.avg(F.when(on, F.col("y")))
    out = long.groupBy("trait").agg(F.count_if("on").alias("n_with"), F.count_if(~F.col("on")).alias("n_without"), F.round(side(F.col("on")), 4).alias("avg_with"), F.round(side(~F.col("on")), 4).alias("avg_without"), F.round(lift(F.col("y"), F.col("on")), 2).alias("lift"))
    return out.where("n_with > 0 and n_without > 0")


def quartiles(papers: DataFrame, feature: str, least: int = 20) -> DataFrame:
    """Mean citations in the first and last quarter by a feature (zeros and nulls left out), and the correlation."""
    rows = papers.where(F.col(feature).isNotNull() & (F.col(feature) != 0)).select("arxiv_id", F.col(feature).cast("double").alias("f"), cites().alias("y"))
    # The ranks span the table: sorted by range, each range's rank begins after the ranges before it.
    ranked = global_rank(rows, [F.asc("f"), F.asc("arxiv_id")])
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.corr("f", "y").alias("r"))
    out = ranked.crossJoin(F.broadcast(total)).where(F.col("n") >= least)
    q1, q4 = F.col("rank") < F.floor(F.col("n") / 4), F.col("rank") >= F.floor(F.col("n") * 3 / 4)
    out = out.agg(F.round(F.avg(F.when(q1, F.col("y"))), 4).alias("q1_avg"), F.round(F.avg(F.when(q4, F.col("y"))), 4).alias("q4_avg"), F.first("r").alias("r"), F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("n") < 10, "insufficient").when(F.col("r") > 0.3, "positive").when(F.col("r") < -0.3, "negative").otherwise("none")
    return out.select(F.lit(feature).alias("feature"), "n", "q1_avg", "q4_avg", label.alias("correlation"))


def global_rank(rows: DataFrame, keys: list[Column], out: str = "rank") -> DataFrame:
    """0-based rank over a whole table without one task for it: sort by range, count each range, add what stands before.

    The sorted rows with their places are written once: sizes and ranks are read from the same table.
    """
    ranged = cut(rows.orderBy(*keys).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__local", F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return ranged.join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + F.col("__local")).drop("__part", "__at", "__local", "__before")


def group_success(papers: DataFrame, key: str | Column, least: int = 10, name: str = "key") -> DataFrame:
    """Mean, maximum, upper median and top-tenth threshold of the citations of each group."""
    k = F.col(key) if isinstance(key, str) else key
    rows = papers.select(k.alias(name), cites().alias("y")).where(F.col(name).isNotNull())
    out = runs(rows, [name], "y").groupBy(name).agg(
        F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("y")) / F.sum("n"), 4).alias("avg_citations"), F.max("y").alias("max_citations"),
        at(F.floor(F.col("size") / 2), "y").alias("median_citations"), at(F.col("size") - 1 - F.floor(F.col("size") / 10), "y").alias("top10_threshold"),
    )
    return out.where(F.col("n") >= least)


def item_success(papers: DataFrame, items: str = "methods", least: int = 10) -> DataFrame:
    rows = papers.select(F.explode(F.array_distinct(items)).alias("item"), cites().alias("y"))
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 4).alias("avg_citations"), F.max("y").alias("max_citations")).where(F.col("n") >= least)


def buckets(papers: DataFrame, value: Column, bounds: list[tuple[float, str]], rest: str) -> DataFrame:
    """Papers and mean, median citations by bucket of a value."""
    rows = papers.select(bucket(value, bounds, rest).alias("bucket"), cites().alias("y"))
    return runs(rows, ["bucket"], "y").groupBy("bucket").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("y")) / F.sum("n"), 4).alias("avg_citations"), percentile("y", 0.5).alias("median_citations"))


def simple_impact(papers: DataFrame, features: dict[str, Column], more_than: int = 10) -> DataFrame:
    """Mean of each feature among papers cited more than so often over that among the others; only where the latter is above 0."""
    high = F.col("y") > more_than
    rows = papers.select(cites().alias("y"), F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.coalesce(v.cast("double"), F.lit(0.0)).alias("v")) for k, v in features.items()])).alias("s")).select("y", "s.*")
    mean = lambda cond: F.sum(F.when(cond, F.col("v")).otherwise(0.0)) / F.greatest(F.count_if(cond), F.lit(1))
    out = rows.groupBy("feature").agg(mean(high).alias("high"), mean(~high).alias("low")).where("low > 0")
    return out.select("feature", F.round("high", 4).alias("high"), F.round("low", 4).alias("low"), F.round(F.col("high") / F.col("low"), 4).alias("multiplier"))


H_BUCKETS = [(5, "0-5"), (15, "6-15"), (30, "16-30"), (50, "31-50")]
TEAM_BUCKETS = [(1, "solo"), (3, "2-3"), (6, "4-6")]


def formula(papers: DataFrame, factors: dict[str, Column]) -> DataFrame:
    """One row: the lift of each factor (a boolean column)."""
    return papers.select(cites().alias("y"), *[F.coalesce(v, F.lit(False)).alias(k) for k, v in factors.items()]).agg(*[F.round(F.coalesce(lift(F.col("y"), F.col(k)), F.lit(1.0)), 2).alias(k) for k in factors])


def ranked_formula(one: DataFrame) -> DataFrame:
    """The factors as rows with an interpretation."""
    long = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("factor"), F.col(k).alias("multiplier")) for k in one.columns])).alias("s")).select("s.*")
    said = F.when(F.col("multiplier") > 2, "strong").when(F.col("multiplier") > 1.2, "moderate").when(F.col("multiplier") > 0.8, "neutral").otherwise("negative")
    return long.withColumn("strength", said)


def score(papers: DataFrame, one: DataFrame, factors: dict[str, Column]) -> DataFrame:
    """Each paper's product of the multipliers that apply to it."""
    named = one.select(*[F.col(k).alias(f"__{k}") for k in factors])
    product = reduce(lambda a, b: a * b, [F.when(F.coalesce(v, F.lit(False)), F.col(f"__{k}")).otherwise(1.0) for k, v in factors.items()])
    return papers.crossJoin(F.broadcast(named)).select("arxiv_id", F.round(product, 4).alias("score"))


def median_of(values: Column) -> Column:
    return upper_median(values)
