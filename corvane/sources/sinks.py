"""Sinks: CSV and JSON data sets, per-category tables, checkpoints by category, graph exports, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat(papers: DataFrame, first: tuple[str, ...] = ("arxiv_id", "title", "published_date", "primary_category", "citations")) -> DataFrame:
    """Lists as strings ("; " for authors, ", " else), important columns first."""
    order = [c for c in first if c in papers.columns] + sorted(c for c in papers.columns if c not in first)
    kinds = dict(papers.dtypes)
    return papers.select(*[F.array_join(F.col(c).cast("array<string>"), "; " if "author" in c else ", ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in order])


def dataset(papers: DataFrame, folder: str) -> None:
    """papers as CSV and JSON."""
    flat(papers).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/papers_csv")
    papers.write.mode("overwrite").json(f"{folder}/papers_json")


def by_category(papers: DataFrame, folder: str, key: str = "primary_category") -> None:
    flat(papers).withColumn("category", F.col(key)).write.mode("overwrite").partitionBy("category").option("header", True).csv(folder)


def checkpoint(papers: DataFrame, folder: str, key: str = "primary_category") -> None:
    """Append finished categories; ``completed`` tells which they are."""
    papers.withColumn("category", F.col(key)).write.mode("append").partitionBy("category").parquet(folder)


def completed(spark, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select("category").distinct()


def sheet(papers: DataFrame, key: str = "primary_category") -> DataFrame:
    """Summary sheet: papers, citations, most frequent venue, dates of each category."""
    return papers.groupBy(key).agg(F.count(F.lit(1)).alias("papers"), F.sum(F.coalesce("citations", F.lit(0))).alias("citations"), F.round(F.avg(F.coalesce("citations", F.lit(0))), 2).alias("avg_citations"), F.mode("venue").alias("top_venue"), F.min("published_date").alias("first"), F.max("published_date").alias("last"))


def network(edges: DataFrame, sizes: DataFrame, n: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes (the n largest) and the edges among them."""
    nodes = sizes.orderBy(F.desc("papers"), F.asc("author")).limit(n)
    inside = nodes.select("author")
    e = edges.join(inside.withColumnRenamed("author", "a"), "a", "left_semi").join(inside.withColumnRenamed("author", "b"), "b", "left_semi")
    return nodes, e


def analysis(results: dict[str, DataFrame], folder: str) -> None:
    """One JSON folder for each named result."""
    for name, df in results.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def report(title: str, parts: dict[str, DataFrame], n: int = 20, kind: str = "markdown") -> str:
    """A report of small tables, the first n rows of each, as Markdown, HTML or JSON."""
    import html
    import json

    rows = {k: [r.asDict(recursive=True) for r in df.limit(n).collect()] for k, df in parts.items()}
    if kind == "json":
        return json.dumps({"title": title, **rows}, default=str, ensure_ascii=False)
    out = [f"# {title}" if kind == "markdown" else f"<h1>{html.escape(title)}</h1>"]
    for k, rs in rows.items():
        cols = parts[k].columns
        if kind == "markdown":
            out += [f"\n## {k}\n", "| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols)]
            out += ["| " + " | ".join(str(r[c]).replace("|", "\\|") for c in cols) + " |" for r in rs]
        else:
            cells = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{html.escape(str(x))}</{tag}>" for x in xs) + "</tr>"
            out += [f"<h2>{html.escape(k)}</h2>", "<table>", cells("th", cols), *[cells("td", [r[c] for c in cols]) for r in rs], "</table>"]
    return "\n".join(out)
