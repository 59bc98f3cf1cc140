"""The tables of the engine from plain star-schema tables, so that every operator can run on generated data.

papers: one row for each order. Authors are the suppliers of its lines, categories the brands, methods the part types,
citations the quantity ordered. ``as_of`` stands for today wherever ages are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-12-31"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    own = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_suppkey")).alias("author_list"),
        F.array_sort(F.collect_set("p_brand")).alias("category_list"),
        F.array_sort(F.collect_set("p_type")).alias("methods"),
        F.min("p_brand").alias("primary_category"),
        F.sum("l_quantity").cast("long").alias("citations"),
    )
    orders = read(spark, sf_dir, "orders")
    date = F.col("o_orderdate").cast("date")
    base = orders.select(
        F.col("o_orderkey").alias("arxiv_id"),
        F.col("o_custkey").alias("custkey"),
        date.alias("published_date"),
        F.date_format(date, "yyyy-MM").alias("month"),
        F.year(date).alias("year"),
        F.datediff(F.lit(as_of).cast("date"), date).alias("paper_age_days"),
        (F.col("o_orderstatus") == "F").alias("has_code"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_survey"),
        F.col("o_orderpriority").alias("venue"),
        F.col("o_totalprice").alias("price"),
    )
    out = base.join(own, F.col("arxiv_id") == F.col("l_orderkey"), "left").drop("l_orderkey")
    velocity = F.col("citations") / F.greatest(F.col("paper_age_days") / 30.44, F.lit(1.0))
    return out.withColumn("velocity", velocity)


def collected(raw: DataFrame, as_of: Column) -> DataFrame:
    """Papers from a feed with the columns that the analyses take: what only a look-up knows (citations, venue) is 0 or null until then."""
    from ..operators import text as words
    from ..operators.stats import is_survey

    typed = {"citations": "long", "venue": "string"}
    out = raw.withColumns({c: F.col(c).cast(t) if c in raw.columns else F.lit(None).cast(t) for c, t in typed.items()})
    both = F.concat_ws(" ", "title", "abstract")
    out = out.withColumn("published_date", F.to_date("published"))
    out = out.withColumns({
        "citations": F.coalesce("citations", F.lit(0)), "month": F.date_format("published_date", "yyyy-MM"), "year": F.year("published_date"), "paper_age_days": F.datediff(as_of.cast("date"), F.col("published_date")),
        "methods": words.methods(both), "has_code": F.lower(both).rlike(r"\bgithub\b|\bcode is available\b|\bour code\b"), "is_survey": is_survey(F.col("title"), F.col("abstract")),
    })
    return out.withColumn("velocity", F.col("citations") / F.greatest(F.col("paper_age_days") / 30.44, F.lit(1.0)))


#: The same in SQL, as common table expressions.
PAPERS_SQL = f"""
own AS (
  SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS author_list, list_sort(list(DISTINCT p_brand) FILTER (WHERE p_brand IS NOT NULL)) AS category_list,
    list_sort(list(DISTINCT p_type) FILTER (WHERE p_type IS NOT NULL)) AS methods, min(p_brand) AS primary_category, CAST(sum(l_quantity) AS BIGINT) AS citations
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
papers AS (
  SELECT o_orderkey AS arxiv_id, o_custkey AS custkey, CAST(o_orderdate AS DATE) AS published_date, strftime(o_orderdate, '%Y-%m') AS month,
    CAST(year(o_orderdate) AS INTEGER) AS year, CAST(DATE '{AS_OF}' - CAST(o_orderdate AS DATE) AS INTEGER) AS paper_age_days,
    o_orderstatus = 'F' AS has_code, o_orderpriority = '1-URGENT' AS is_survey, o_orderpriority AS venue, o_totalprice AS price,
    author_list, category_list, methods, primary_category, citations,
    citations / greatest(CAST(DATE '{AS_OF}' - CAST(o_orderdate AS DATE) AS DOUBLE) / 30.44, 1.0) AS velocity
  FROM orders LEFT JOIN own ON o_orderkey = l_orderkey)
"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation history in long form (arxiv_id, year, n): suppliers as papers, their lines by ship year as citations."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("arxiv_id"), F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


HISTORY_SQL = "history AS (SELECT l_suppkey AS arxiv_id, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem GROUP BY ALL)"


def sota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows from events: task, dataset, metric, value, date, method."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("task_name"), k.alias("dataset_name"), F.lit("value").alias("metric_name"), F.col("value").alias("metric_value"),
        F.col("ts").alias("evaluation_date"), F.col("user_id").alias("method_name"), F.col("event_id").alias("row_id"),
    )


SOTA_SQL = """sota AS (SELECT event_type AS task_name, CAST(json_extract_string(props, '$.k') AS INTEGER) AS dataset_name, 'value' AS metric_name,
  value AS metric_value, ts AS evaluation_date, user_id AS method_name, event_id AS row_id FROM events)"""
