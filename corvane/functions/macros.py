"""Expressions and small plans that many operators share; all of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir; one of its own only where the session has none and all runs in one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            import re
            import tempfile

            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="corvane-")
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder, read back. For loops: a checkpoint keeps the size that the optimizer guessed, and the guess of
    a join is a product, so that over some rounds it grows beyond what the planner can multiply; a file has its own size.
    """
    import uuid

    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark, most: int) -> None:
    """At most so many bytes in an Arrow batch from now on in this session; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "268435456b").lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


#: Elements of a list whose pairs one task makes by themselves; longer lists are cut into blocks of so many.
LIST_BLOCK = 256


def explode_pairs(df: DataFrame, array: str, a: str = "a", b: str = "b", keep: tuple[str, ...] = (), block: int = LIST_BLOCK) -> DataFrame:
    """Unordered pairs of distinct elements of a row's array, a < b.

    Lists of at most ``block`` elements give their pairs where they lie, before any shuffle. Longer ones are cut into blocks, and
    pairs of blocks, each with at most block squared pairs, are dealt over tasks; only these short lists move.
    """
    own = df.select(*keep, F.array_sort(F.array_distinct(F.filter(array, lambda x: x.isNotNull()))).alias("__arr"))
    first = own.where(F.size("__arr") <= block).select(*keep, "__arr", F.posexplode("__arr").alias("__i", a))
    short = first.select(*keep, a, F.explode(F.expr("slice(__arr, __i + 2, size(__arr))")).alias(b))
    cut_ = own.where(F.size("__arr") > block).select(*keep, "__arr", F.explode(F.sequence(F.lit(0), F.floor((F.size("__arr") - 1) / block).cast("int"))).alias("__x"))
    cut_ = cut_.select("*", F.explode(F.sequence(F.col("__x"), F.floor((F.size("__arr") - 1) / block).cast("int"))).alias("__y"))
    part = lambda i: F.slice("__arr", F.col(i) * block + 1, F.lit(block))
    dealt = cut_.select(*keep, "__x", "__y", part("__x").alias("__left"), part("__y").alias("__right"))
    # A given number of tasks: blocks are small before their pairs are made, so adaptive execution would put them together.
    dealt = dealt.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), F.xxhash64("__left", "__right", "__x", "__y"))
    first = dealt.select(*keep, "__x", "__y", "__right", F.posexplode("__left").alias("__i", a))
    rest = F.when(F.col("__x") == F.col("__y"), F.expr("slice(__right, __i + 2, size(__right))")).otherwise(F.col("__right"))
    return short.unionByName(first.select(*keep, a, F.explode(rest).alias(b)))


def top(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The first n rows; compiles to TakeOrderedAndProject."""
    return df.orderBy(*keys).limit(n)


def top_per(df: DataFrame, group: list[str], n: int, *keys: Column) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*group).orderBy(*keys))).where(F.col("__rn") <= n).drop("__rn")


def ordinal(df: DataFrame, entity: list[str], period: str) -> DataFrame:
    """With x (0-based rank of the period in its entity) and n (periods of the entity); gaps are not filled."""
    w = W.partitionBy(*entity)
    return df.withColumn("x", F.row_number().over(w.orderBy(period)) - 1).withColumn("n", F.count(F.lit(1)).over(w))


def slope(y: str | Column, x: str | Column = "x") -> Column:
    """Least squares slope; 0 for fewer than two points."""
    return F.coalesce(F.regr_slope(c(y), c(x)), F.lit(0.0))


def r2(y: str | Column, x: str | Column = "x") -> Column:
    """R squared, clamped at 0; 0 for a constant series."""
    flat = F.coalesce(F.var_pop(c(y)), F.lit(0.0)) == 0
    return F.when(flat, F.lit(0.0)).otherwise(F.greatest(F.coalesce(F.regr_r2(c(y), c(x)), F.lit(0.0)), F.lit(0.0)))


def early(rn: Column, n: Column, parts: int) -> Column:
    """Among the first floor(n / parts), rn from 0."""
    return rn < F.floor(n / parts)


def recent(rn: Column, n: Column, parts: int) -> Column:
    """Among the last ceil(n / parts), rn from 0."""
    return rn >= n - F.ceil(n / parts)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as a double, null where b is 0."""
    return c(a).cast("double") / F.nullif(c(b).cast("double"), F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """Rounded like SQL's doubles: the scaled value to the nearest whole number, halves away from 0. F.round takes the decimal that
    is shown for x instead, and the two part where x ends in a half at that digit.
    """
    return F.round(x * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def lift(y: Column, flag: Column, least: float = 0.1) -> Column:
    """Mean of y with the flag over its mean without (at least ``least``)."""
    return F.avg(F.when(flag, y)) / F.greatest(F.avg(F.when(~flag, y)), F.lit(least))


def upper_median(values: Column) -> Column:
    """Element n div 2 (from 0) of the sorted values."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def bucket(value: Column, bounds: list[tuple[float, str]], rest: str) -> Column:
    """Label of the first bound that the value does not exceed."""
    out = F.lit(rest)
    for most, name in reversed(bounds):
        out = F.when(value <= most, name).otherwise(out)
    return out
