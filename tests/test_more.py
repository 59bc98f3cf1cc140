"""Weighted terms, lineage, topics over the years, title traits and back-filled papers against hand-made cases."""

from pyspark.sql import functions as F

from corvane.operators import authors, gaps, graph, impact, text
from corvane.sources import readers


def test_weighted_terms(spark):
    rows = spark.createDataFrame([("a", "CNNs", 1.0), ("a", "cnn", 2.0), ("a", "the", 9.0), ("a", "x1", 5.0), ("a", "old", 4.0), ("a", None, 1.0), ("b", "cnn", 7.0)], "doc string, term string, score double")
    got = {(r["doc"], r["term"]): r["score"] for r in text.process_keywords(rows, ["The", "stale"], [r"x\d"], {"CNNs": "cnn", "old": "Stale"}, ("doc",)).collect()}
    assert got == {("a", "cnn"): 3.0, ("b", "cnn"): 7.0}
    assert {(r["term"], r["score"]) for r in text.process_keywords(rows.where("term = 'cnn'")).collect()} == {("cnn", 9.0)}


def test_roots_and_direct_links(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (6, 7), (8, 2)], "src long, dst long")
    assert {r["id"] for r in graph.lineage_roots(e, 1).collect()} == {5}
    assert graph.lineage_roots(e, 5).first()["id"] == 5 and graph.lineage_roots(e, 8).count() == 1
    assert {(r["direction"], r["id"]) for r in graph.direct(e, 2).collect()} == {("references", 3), ("references", 4), ("citations", 1), ("citations", 8)}
    assert [r["id"] for r in graph.direct(e, 2, 1).orderBy("id").collect()] == [1, 3]


def test_topics_over_the_years_and_hot_groups(spark):
    rows = [(["A", "A"], ["x", "y"], 2000), (["A"], ["x"], 1998), (["A"], ["x"], 1998), (["B"], ["x"], 1990), (["B"], ["x"], 1991), (None, ["x"], 2000), (["C"], None, 2000)]
    got = {(r["author"], r["topic"], r["first_year"], r["last_year"], r["active_years"], r["is_current"]) for r in authors.migration(spark.createDataFrame(rows, "author_list array<string>, category_list array<string>, year int"), 2001).collect()}
    assert got == {("A", "x", 1998, 2000, 2, True), ("B", "x", 1990, 1991, 2, False)}
    hot = spark.createDataFrame([("a", 2.0), ("a", 0.0), ("a", None), ("b", 0.5), (None, 9.0)] + [("c", 5.0)] * 50, "primary_category string, velocity double")
    assert [tuple(r) for r in gaps.hot_low_volume(hot).collect()] == [("a", 1, 2.0)]


def test_title_traits(spark):
    rows = [("a: b?", 10), ("a b c d e f g h i", 2), (None, None), ("x: " + "w " * 20, 4)]
    got = {r["trait"]: (r["n_with"], r["avg_with"], r["avg_without"], r["lift"]) for r in impact.title_traits(spark.createDataFrame(rows, "title string, citations int")).collect()}
    assert got == {"has_colon": (2, 7.0, 1.0, 7.0), "has_question": (1, 10.0, 2.0, 5.0), "short_title": (2, 5.0, 3.0, 1.67)}
    assert spark.range(1).select(impact.words(F.lit(" a\t b\n"))).first()[0] == 2


def test_backfilled(spark):
    papers = spark.createDataFrame([("1", "own", ["U"], "2020-01-01"), ("2", "", [], "2020-01-01"), ("3", None, None, "2020-01-01")], "arxiv_id string, doi string, affiliations array<string>, published_date string").withColumn("published_date", F.to_date("published_date"))
    service = spark.createDataFrame([("1", 5, {"DOI": "d1"}, [(["V"],)]), ("2", 0, {"DOI": "d2"}, [(["V", "W"],), (None,), (["V"],)])], "arxiv_id string, citationCount long, externalIds map<string,string>, authors array<struct<affiliations:array<string>>>")
    got = {r["arxiv_id"]: (r["doi"], r["affiliations"], r["citations"], r["citations_per_month"]) for r in readers.backfilled(papers, service, F.lit("2021-01-01")).collect()}
    assert got["1"] == ("own", ["U"], 5, 0.416) and got["2"] == ("d2", ["V", "W"], 0, 0.0) and got["3"] == (None, None, 0, 0.0)
