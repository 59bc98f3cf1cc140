"""Plumbing the operators share: the shared work folder, written tables, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bytes that one broadcast may hold as a hashed relation.
BROADCAST_BYTES = 48_000_000
#: Rows handed to Python at once; documents can be long, so far below Spark's default of 10,000.
ARROW_ROWS = 1_000
#: Bytes handed to Python at once, for the same reason.
ARROW_BYTES = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Unset, a temporary one, but only if all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def save(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a result to the shared folder and read it back: cuts the lineage, survives lost executors.

    files: the most files, for tables that are small by what bounds them.

    Tables stand under one folder per application, ``<shared>/corvane-<application id>``, for the cluster to sweep.
    The returned DataFrame knows its rows (``rows_of``), counted while they were written, and can be removed (``forget``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/corvane-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df = df.coalesce(files) if files else df
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved = (path, seen.get["rows"])
    return out


def rows_of(saved: DataFrame) -> int:
    """Rows of a saved table."""
    return saved._saved[1]


def forget(saved: DataFrame) -> None:
    """Remove a saved table that nothing reads any more."""
    spark = saved.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(saved._saved[0])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Drop the shuffles and broadcasts of steps that are done: Spark's cleaner follows the driver's garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def bounded_broadcast(saved: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the written table proves it small; else Spark shuffles and AQE splits skew.

    What is bounded is rows times an estimate of a row's bytes in a hashed relation, arrays counted by the file's size.
    """
    spark, (path, rows) = saved.sparkSession, saved._saved
    if rows * (16 + 16 * len(saved.columns)) > most:
        return saved
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(saved) if 4 * stored <= most + (1 << 24) else saved


def ranked(df: DataFrame, keys: list[Column], out: str = "rank") -> DataFrame:
    """With the 0-based rank over all rows, without one task for them: sorted by range and written, then each range's place is added.

    The result knows its rows like a saved table. The sizes of the ranges are one row for each task of the sort.
    """
    part, at, before = (free_name(c, df.columns) for c in ("part", "at", "before"))
    held = save(df.orderBy(*keys).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "sorted")
    sizes = held.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(part, F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
    local = F.col(at) - F.shiftleft(F.col(part).cast("long"), 33)
    ranks = held.join(F.broadcast(starts), part).withColumn(out, F.col(before) + local).drop(part, at, before)
    ranks._saved = held._saved
    return ranks


def text_key(text: Column) -> Column:
    """16 bytes for a text: rows with equal texts have equal keys, whatever their ids; null stays null."""
    return F.unhex(F.md5(text.cast("binary")))


def row_key(id_: Column, text: Column) -> Column:
    """16 bytes for an id with its text: tells rows apart that share an id, or have none."""
    return text_key(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores before it as make it differ from all taken ones (case is ignored)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long documents (lowers the session's settings, never raises them)."""
    for key, usual, most in (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", "268435456b", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = _number(spark.conf.get(key, usual))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def _number(setting: str) -> int:
    """A setting as a number; one with a unit other than bytes counts as none set."""
    digits = setting.lower().removesuffix("b")
    return int(digits) if digits.lstrip("-").isdigit() else 0


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A partition's function that ends by handing freed memory back: Spark keeps its Python workers for later tasks."""

    def run(frames):
        yield from work(frames)
        release()

    return run


def release() -> None:
    """Give what Arrow and the C library hold in reserve back to the system, where they can."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def id_crc(column: str) -> Column:
    """crc32 of an id written as text, unsigned."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
