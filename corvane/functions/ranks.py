"""Ranks inside groups of any size: a histogram first, then ranks by ranges of values, then sums over the ranges.

A group's rows become runs, one for each distinct value with its count, before anything is shuffled by group. The runs of a group are
dealt by ranges of values, whose bounds are quantiles of all runs; inside a range they are counted up in order, and what stands
before a range is a sum over the few ranges of the group. So no task holds a large group, and equal values never pile up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ranges of values; a group's runs are dealt over as many tasks at most.
RANGES = 64


def runs(df: DataFrame, group: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """group, value, n, before, size: each distinct value of each group, its rows, the group's rows with less, all its rows. Nulls come first."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    bounds = counted.agg(F.percentile_approx(F.col(value).cast("double"), [i / ranges for i in range(1, ranges)], 1_000).alias("__bounds"))  # one row
    part = F.coalesce(F.size(F.filter("__bounds", lambda b: b < F.col(value).cast("double"))), F.lit(-1))
    dealt = counted.crossJoin(F.broadcast(bounds)).withColumn("__part", part).drop("__bounds")
    inside = W.partitionBy(*group, "__part")
    local = dealt.withColumn("__local", F.coalesce(F.sum("n").over(inside.orderBy(F.asc_nulls_first(value)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sizes = dealt.groupBy(*group, "__part").agg(F.sum("n").alias("__n"))  # at most ``ranges`` + 1 rows of a group
    of = W.partitionBy(*group)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(of.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("__n").over(of)).drop("__n")
    both = local.join(sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"), "__before", "size"), [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)] + [F.col("__part") == F.col("__p")])
    return both.select(*group, value, "n", (F.col("__local") + F.col("__before")).alias("before"), "size")


def at(place: Column, value: str) -> Column:
    """Of a group's runs: the value at a place, from 0 (an aggregate)."""
    return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value)))


def percentile(value: str, share: float) -> Column:
    """Of a group's runs: the percentile with linear interpolation (an aggregate)."""
    place = (F.col("size") - 1) * F.lit(share)
    low, high = at(F.floor(place), value), at(F.ceil(place), value)
    return low + (high - low) * F.max(place - F.floor(place))


def gini(df: DataFrame, group: list[str], value: str, mode: str = "standard") -> DataFrame:
    """Gini coefficient per group, in [0, 1]; mode "reference": the sign-reversed form, which clamps to 0."""
    n, total = F.sum("n"), F.sum(F.col("n") * F.col(value)).cast("double")
    weighted = F.sum((F.col("n") * F.col("before") + F.col("n") * (F.col("n") + 1) / 2) * F.col(value)).cast("double")
    standard = 2 * weighted / (n * total) - (n + 1) / n
    form = standard if mode == "standard" else -standard
    return runs(df, group, value).groupBy(*group).agg(F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), form))).otherwise(0.0).alias("gini"))


def h_index(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Largest h with h values of at least h."""
    above = F.col("size") - F.col("before") - F.col("n")
    fits = F.greatest(F.lit(0), F.least(F.col("n"), F.floor(F.col(value)) - above))
    return runs(df, group, value).groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col(value).isNotNull(), fits)), F.lit(0)).alias("h_index"))
