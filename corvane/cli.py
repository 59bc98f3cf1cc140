"""Command line: collect papers, analyze a corpus, report on it, or run a registered query over a folder of tables."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import functions as F

from .plans import catalog, drivers, views  # noqa: F401  views registers its queries
from .session import session
from .sources import adapters, readers, service, sinks


def collect(spark, folder: str, endpoint: str, categories: list[str], start: str, end: str, months: int = 6, fetch: str | None = None, pause: float = 3.0, skip_failed: bool = False) -> int:
    """Fetch categories that are not in the folder yet, one by one, each kept as soon as it is whole; then write the data set.

    skip_failed leaves out pages that fail for good; ``failed`` in the folder has them.
    """
    landed = f"{folder}/landed"
    path = spark._jvm.org.apache.hadoop.fs.Path(landed)
    done = {r["category"] for r in sinks.completed(spark, landed).collect()} if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else set()
    chunks = [(r["chunk_start"], r["chunk_end"]) for r in readers.date_chunks(spark, start, end, months).collect()]
    spans = ",".join(f"{a:%Y%m%d}0000/{b:%Y%m%d}2359" for a, b in chunks)
    spark.dataSource.register(service.PaperSource)
    for c in categories:
        if c not in done:
            options = {"endpoint": endpoint, "categories": c, "spans": spans, "pause": str(pause)} | ({"fetch": fetch} if fetch else {}) | ({"skipfailed": "true", "failures": f"{folder}/failed"} if skip_failed else {})
            sinks.checkpoint(spark.read.format("papers").options(**options).load().dropDuplicates(["arxiv_id"]).selectExpr("*", f"'{c}' as asked"), landed, "asked")
    papers = spark.read.parquet(landed).drop("category").dropDuplicates(["arxiv_id"])
    sinks.dataset(papers, folder)
    return papers.count()


def corpus(spark, tables: str) -> drivers.Corpus:
    """The corpus of a folder: what ``collect`` left there, or else prepared tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{tables}/papers_json")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        papers = adapters.collected(readers.existing(spark, tables), F.current_date())
        return drivers.Corpus(papers, datetime.date.today().year)
    return drivers.Corpus(adapters.papers(spark, tables), catalog.NOW, history=adapters.history(spark, tables), sota=adapters.sota(spark, tables), citations=catalog._chain(spark, tables))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corvane")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("query", help="one query, written as Parquet")
    run.add_argument("name", choices=sorted(catalog.QUERIES))
    run.add_argument("tables")
    run.add_argument("out")
    rep = sub.add_parser("report", help="a report of several queries")
    rep.add_argument("tables")
    rep.add_argument("out")
    rep.add_argument("--format", choices=("markdown", "html", "json"), default="markdown")
    rep.add_argument("--queries", nargs="*", default=["summary_stats", "category_trends", "category_pairs", "influential_authors", "opportunity_scores"])
    get = sub.add_parser("collect", help="papers of categories and dates from a feed")
    get.add_argument("out")
    get.add_argument("--endpoint", default="https://export.arxiv.org/api/query")
    get.add_argument("--categories", nargs="+", required=True)
    get.add_argument("--start", required=True)
    get.add_argument("--end", required=True)
    get.add_argument("--months", type=int, default=6)
    get.add_argument("--pause", type=float, default=3.0)
    get.add_argument("--skip-failed", action="store_true", help="leave out pages that fail for good, and say which")
    get.add_argument("--fetch", help="module.function that fetches a url in the usual one's place")
    run = sub.add_parser("analyze", help="every table of the analysis, as JSON; goes on where it broke off")
    run.add_argument("tables")
    run.add_argument("out")
    run.add_argument("--only", nargs="*")
    rep.add_argument("--research", action="store_true", help="the nine sections of the research report instead of single queries")
    a = p.parse_args(argv)
    spark = session()
    if a.command == "query":
        catalog.QUERIES[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)
    elif a.command == "collect":
        print(collect(spark, a.out, a.endpoint, a.categories, a.start, a.end, a.months, a.fetch, a.pause, a.skip_failed), "papers")
        for r in service.failed_pages(spark, f"{a.out}/failed").toLocalIterator():
            print("left out:", r["category"], r["start"], r["end"], "from", r["at"], r["error"], "(the rest of the span too)" if r["span_ended"] else "")
    elif a.command == "analyze":
        whole = corpus(spark, a.tables)
        print("\n".join([*whole.analyze(a.out, a.only), *drivers.summary_lines(whole)]))
    elif a.research:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(drivers.research_report(corpus(spark, a.tables), kind=a.format))
    else:
        text = sinks.report("Corpus report", {q: catalog.QUERIES[q](spark, a.tables) for q in a.queries}, kind=a.format)
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
