"""Whole analyses: named lazy tables over one corpus, written one by one, and the research report made of them.

Each driver returns {name: table}; a table that needs jobs to be planned (graph iterations) is a function that makes it, so
nothing runs until a table is written or shown. ``papers`` has the columns of the
adapter tables; parts whose columns a corpus lacks are left out by ``Corpus``, which says which ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.macros import cut
from ..operators import authors, benchmarks, fulltext, gaps, graph, impact, landscape, linkage, stats, text, trajectories, trends, vectors
from ..sources import sinks

Table = DataFrame | Callable[[], DataFrame]


def made(table: Table) -> DataFrame:
    return table() if callable(table) else table


def trend_tables(papers: DataFrame, items: str = "methods") -> dict[str, Table]:
    by = trends.series(papers, "primary_category")
    used = trends.series(papers, "item", items)
    words = trends.keyword_trends(papers, items)
    return {
        "category_trends": trends.trend(by, "primary_category"), "category_forecast": trends.forecast(by, "primary_category"), "category_growth": trends.growth(by, "primary_category"), "method_trends": trends.trend(used, "item"),
        "keyword_trends": words, "emerging_keywords": trends.emerging_keywords(words), "velocity": trends.velocity_by(papers), "saturation": trends.saturation(papers), "hot_papers": trends.hot(papers), "sleeping": trends.sleeping(papers), "quarters": trends.quarterly(papers),
    }


def gap_tables(papers: DataFrame, items: str = "methods") -> dict[str, Table]:
    return {
        "category_pairs": gaps.pair_gaps(papers), "cross_discipline": gaps.pair_gaps(gaps.prefixes(papers), "prefixes", min_expected=10), "method_gaps": gaps.domain_gaps(papers, items), "reproducibility": gaps.reproducibility(papers), "code_rates": gaps.code_rate(papers),
        "surveys": gaps.survey_opportunities(papers), "opportunities": gaps.opportunity_scores(papers), "hot_low_volume": gaps.hot_low_volume(papers), "view_scores": gaps.view_scores(papers), "simple_pairs": gaps.simple_pair_gaps(papers),
    }


def success_tables(papers: DataFrame, items: str = "methods", least: int = 50) -> dict[str, Table]:
    """Success factors; no tables where fewer than ``least`` papers are cited."""
    if papers.where("citations > 0").limit(least).count() < least:
        return {}
    factors = {"has_code": F.col("has_code"), "is_survey": F.col("is_survey"), "team": F.size("author_list") > 3}
    one = impact.formula(papers, factors)
    out = {
        "lifts": impact.binary_lifts(papers, ["has_code", "is_survey"]), "categories": impact.group_success(papers, "primary_category"), "venues": impact.group_success(papers, "venue", 5), "methods": impact.item_success(papers, items),
        "team_size": impact.buckets(papers, F.coalesce(F.when(F.col("author_list").isNotNull(), F.size("author_list")), F.lit(1)), impact.TEAM_BUCKETS, "7+"), "h_index": impact.buckets(papers.join(authors.best_h(papers), "arxiv_id"), F.col("max_h"), impact.H_BUCKETS, "50+"),
        "formula": impact.ranked_formula(one), "scores": impact.score(papers, one, factors), "simple": impact.simple_impact(papers, {"authors": F.size(F.coalesce("author_list", F.array())), "code": F.col("has_code")}),
    }
    if "title" in papers.columns:
        out["title_traits"] = impact.title_traits(papers)
    if "abstract" in papers.columns:
        out["abstract_words"] = impact.buckets(papers, impact.words("abstract"), impact.ABSTRACT_BUCKETS, "very long (300+)")
    return out


def author_tables(papers: DataFrame, now: int) -> dict[str, Table]:
    return {
        "rollup": authors.rollup(papers), "prolific": authors.prolific(papers), "influential": authors.influential(papers), "by_h_index": authors.influential_h(papers), "rising": authors.rising(papers, now), "timeline": authors.timeline(papers), "trend": authors.timeline_trend(papers),
        "growth": authors.citation_growth(papers), "momentum": authors.momentum(papers), "topics": authors.topics(papers), "migration": authors.migration(papers, now), "careers": authors.careers(papers, now), "breadth": authors.cumulative_coauthors(papers), "collaboration": authors.collaboration_patterns(papers), "index": authors.index_summary(papers),
    }


def network_tables(papers: DataFrame, least: int = 1, sources: int = 100) -> dict[str, Table]:
    edges = graph.coauthor_edges(papers, least)
    return {
        "degrees": graph.degrees(edges), "stats": graph.network_stats(edges), "clusters": lambda: graph.clusters(edges, papers), "teams": graph.team_metrics(papers, edges), "collaboration": graph.collaboration(papers), "bridges": graph.category_bridges(papers),
        "betweenness": lambda: graph.betweenness(edges, sources), "top_pairs": authors.top_pairs(papers),
    }


def citation_tables(papers: DataFrame, edges: DataFrame) -> dict[str, Table]:
    """edges: (src, dst), src cites dst."""
    return {
        "foundational": graph.foundational(edges, papers), "bridges": lambda: graph.citation_bridges(edges, papers), "pagerank": lambda: graph.pagerank(edges), "stats": graph.graph_stats(edges), "components": lambda: graph.component_sizes(edges),
        "nodes": graph.export(edges, papers)["nodes"], "edges": edges, "degrees": lambda: graph.degree_spread(edges),
    }


def trajectory_tables(history: DataFrame, now: int) -> dict[str, Table]:
    v = trajectories.velocity(history, now)
    return {
        "cumulative": trajectories.cumulative(history), "velocity": v, "velocity_distribution": v.groupBy("trend").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("per_year"), 4).alias("avg_per_year")), "momentum": trajectories.momentum(history, now),
        "sleeping": trajectories.sleeping_beauties(history, now), "declining": trajectories.declining(history, now), "predicted": trajectories.predict(history, now), "milestones": trajectories.milestones(history), "yearly": trajectories.yearly_totals(history),
    }


def text_tables(docs: DataFrame, title: str = "title", abstract: str = "abstract", stop: list[str] = (), merges: dict[str, str] | None = None) -> dict[str, Table]:
    """Without stop words and merges: the plain variant that knows no vocabulary."""
    said = text.analyze(docs, title, abstract)
    toks = text.normalise(text.tokens(docs, F.concat_ws(" ", title, abstract)), stop, merges)
    return {
        "papers": said, "methods": text.frequency(said, "methods_detected"), "datasets": text.frequency(said, "datasets_mentioned") if "datasets_mentioned" in said.columns else text.frequency(docs.select(text.datasets(F.col(abstract)).alias("found")), "found"),
        "keywords": text.doc_keywords(docs, title, abstract, stop=stop, merges=merges), "tfidf": text.tfidf(toks), "pairs": text.cooccurrence(toks), "topics": text.topics(toks),
    }


def fulltext_tables(docs: DataFrame, body: str = "text") -> dict[str, Table]:
    secs = fulltext.sections(docs, body)
    lim, fut = fulltext.limitations(docs, secs, body), fulltext.future_work(docs, secs, body)
    methods = secs.where("section = 'methods'").select(F.col("id").alias("arxiv_id"), fulltext.method_details(F.col("content")).alias("details"))
    return {"sections": fulltext.section_frequency(secs), "signatures": fulltext.signatures(secs), "structure": fulltext.structure(docs, body), "limitations": lim, "themes": fulltext.theme_counts(lim), "future_work": fut, "directions": fulltext.theme_counts(fut, "directions"), "methods": methods}


def benchmark_tables(sota: DataFrame, since: str) -> dict[str, Table]:
    e = benchmarks.ranked(sota)
    return {
        "progression": benchmarks.progression(sota), "solved": benchmarks.solved(sota), "active": benchmarks.active(sota, since), "underserved": benchmarks.underserved(sota), "metrics": benchmarks.metrics(sota), "improvements": benchmarks.improvements(sota),
        "tasks": benchmarks.leading(e, "task_name"), "datasets": benchmarks.leading(e, "dataset_name"),
    }


def vector_tables(rows: DataFrame, titles: DataFrame | None = None, k: int = 20, near: int = 10) -> dict[str, Table]:
    """rows: (vec_id, embedding); titles: (vec_id, title), for the labels of clusters and the topics of gaps."""
    found = vectors.kmeans(rows, k)
    label = "cluster" if "cluster" in found.columns else found.columns[-1]
    labelled = rows.drop("label").join(found.select("vec_id", F.col(label).alias("label")), "vec_id")
    gaps = cut(vectors.embedding_gaps(rows, near))
    out = {"clusters": labelled.select("vec_id", "label"), "silhouette": vectors.silhouette(labelled), "gaps": gaps, "coverage": vectors.coverage(gaps), "axes": vectors.landscape(rows), "landscape": lambda: landscape.landscape(rows), "linkage": lambda: linkage.centre_distances(rows, linkage.clusters(rows, k))}
    if titles is not None:
        named = labelled.select("vec_id", "label").join(titles, "vec_id")
        far = gaps.where("sparse").orderBy(F.desc("isolation"), F.asc("vec_id")).limit(20).join(titles, "vec_id")
        out |= {"labels": vectors.title_words(named, "label", "title", 3, 3), "gap_topics": vectors.title_words(far, None, "title", 4, 10)}
    return out


@dataclass
class Corpus:
    """One corpus and all that can be asked of it; optional tables switch their parts on."""

    papers: DataFrame
    now: int
    citations: DataFrame | None = None
    history: DataFrame | None = None
    sota: DataFrame | None = None
    texts: DataFrame | None = None
    embeddings: DataFrame | None = None
    items: str = "methods"

    def tables(self, parts: set[str] | None = None) -> dict[str, Table]:
        """Tables as part/name, of some parts or of all that the corpus has data for."""
        p = self.papers
        have: dict[str, Callable[[], dict[str, Table]]] = {
            "overview": lambda: {"summary": stats.summary(p), "statistics": stats.grouping_statistics(p), "by_category": stats.by_category(p), "cited": stats.top_lists(p, {"cited": (F.col("citations").isNotNull(), F.col("citations"))})},
            "trends": lambda: trend_tables(p, self.items), "gaps": lambda: gap_tables(p, self.items), "success": lambda: success_tables(p, self.items), "authors": lambda: author_tables(p, self.now), "network": lambda: network_tables(p),
        }
        if {"title", "abstract"} <= set(p.columns):
            have["text"] = lambda: text_tables(p)
        if self.citations is not None:
            have["citations"] = lambda: citation_tables(p, self.citations)
        if self.history is not None:
            have["trajectories"] = lambda: trajectory_tables(self.history, self.now)
        if self.sota is not None:
            have["benchmarks"] = lambda: benchmark_tables(self.sota, f"{self.now - 1}-01-01")
        if self.texts is not None:
            have["fulltext"] = lambda: fulltext_tables(self.texts)
        if self.embeddings is not None:
            titles = p.select(F.col("arxiv_id").alias("vec_id"), "title") if "title" in p.columns else None
            have["vectors"] = lambda: vector_tables(self.embeddings, titles)
        return {f"{part}/{name}": t for part, make in have.items() if parts is None or part in parts for name, t in make().items()}

    def analyze(self, folder: str, only: list[str] | None = None) -> list[str]:
        """Write every table that is not there yet, so that a run that broke off goes on; returns the names written."""
        spark, done = self.papers.sparkSession, []
        fs = lambda path: path.getFileSystem(spark._jsc.hadoopConfiguration())
        for name, table in self.tables({x.split("/")[0] for x in only} if only else None).items():
            if only and name.split("/")[0] not in only and name not in only:
                continue
            mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
            if not fs(mark).exists(mark):
                sinks.analysis({name: made(table)}, folder)
                done.append(name)
        return done


#: Sections of the research report: title, tables of ``Corpus.tables``.
SECTIONS = [
    ("Overview", ["overview/summary", "overview/by_category"]), ("Trends", ["trends/category_trends", "trends/category_forecast", "trends/emerging_keywords"]), ("Most cited and rising papers", ["overview/cited", "trends/hot_papers", "trends/sleeping"]),
    ("Research gaps", ["gaps/category_pairs", "gaps/method_gaps"]), ("Opportunities", ["gaps/opportunities", "gaps/surveys", "gaps/reproducibility"]), ("Success factors", ["success/formula", "success/categories", "success/h_index"]),
    ("Authors", ["authors/influential", "authors/rising"]), ("Collaboration", ["network/stats", "network/collaboration", "network/bridges"]), ("Citations and benchmarks", ["citations/foundational", "trajectories/momentum", "benchmarks/solved", "benchmarks/underserved"]),
]


def research_report(corpus: Corpus, n: int = 15, kind: str = "markdown") -> str:
    """The nine sections with the first rows of each table that the corpus has."""
    have = corpus.tables({name.split("/")[0] for _, names in SECTIONS for name in names})
    parts = {f"{title}: {name.split('/')[1].replace('_', ' ')}": made(have[name]) for title, names in SECTIONS for name in names if name in have}
    return sinks.report("Research report", parts, n, kind)


def summary_lines(corpus: Corpus) -> list[str]:
    """What a console shows after a run."""
    r = stats.summary(corpus.papers).first().asDict()
    return [f"{k.replace('_', ' ')}: {v}" for k, v in r.items()]
