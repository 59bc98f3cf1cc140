"""Drivers, command line and collection over the smallest tables and a canned feed."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corvane import cli
from corvane.operators import benchmarks, fulltext, graph, trends
from corvane.plans import drivers
from corvane.sources import readers

SF = "/root/testdata/sf0.001"
ENTRY = "<entry><id>http://arxiv.org/abs/{i}v2</id><title>Paper {i}</title><summary>s</summary><published>2020-01-0{d}T00:00:00Z</published><author><name>A</name></author><category term='{c}'/></entry>"


def fetch(url):
    """Five papers of each category and span."""
    import re
    from urllib.parse import parse_qs, urlparse

    q = parse_qs(urlparse(url).query)
    at, most = int(q["start"][0]), int(q["max_results"][0])
    c = re.search(r"cat:(\S+)", q["search_query"][0])[1]
    rows = [ENTRY.format(i=f"{c}.{k}", d=k + 1, c=c) for k in range(5)][at : at + most]
    return f"<feed xmlns='http://www.w3.org/2005/Atom'>{''.join(rows)}</feed>".encode()


def test_collect_goes_on_and_reads_every_page(spark, tmp_path):
    n = cli.collect(spark, f"{tmp_path}/c", "http://feed", ["x.A"], "2020-01-01", "2020-03-01", fetch="tests.test_drivers.fetch", pause=0)
    assert n == 5
    assert cli.collect(spark, f"{tmp_path}/c", "http://feed", ["x.A", "x.B"], "2020-01-01", "2020-03-01", fetch="tests.test_drivers.fetch", pause=0) == 10
    got = readers.existing(spark, f"{tmp_path}/c")
    assert {r["arxiv_id"] for r in got.collect()} == {f"x.{c}.{k}" for c in "AB" for k in range(5)}
    with pytest.raises(FileNotFoundError):
        readers.existing(spark, f"{tmp_path}/nothing")
    assert cli.main(["analyze", f"{tmp_path}/c", f"{tmp_path}/a", "--only", "overview", "trends/category_trends", "network/degrees"]) == 0
    assert spark.read.json(f"{tmp_path}/a/overview/summary").first()["papers"] == 10
    assert sorted(os.listdir(f"{tmp_path}/a")) == ["network", "overview", "trends"]


def test_analyze_writes_what_is_missing_and_reports(spark, tmp_path):
    out = f"{tmp_path}/a"
    assert cli.main(["analyze", SF, out, "--only", "overview", "gaps/opportunities"]) == 0
    assert sorted(os.listdir(out)) == ["gaps", "overview"] and os.listdir(f"{out}/gaps") == ["opportunities"]
    whole = cli.corpus(spark, SF)
    assert whole.analyze(out, ["overview"]) == []
    names = {r["name"] for r in readers.analysis_json(spark, out).collect()}
    assert {"summary", "opportunities"} <= names
    assert cli.main(["report", SF, f"{tmp_path}/r.json", "--research", "--format", "json"]) == 0
    with open(f"{tmp_path}/r.json", encoding="utf-8") as f:
        made = json.load(f)
    assert len({k.split(":")[0] for k in made if ":" in k}) == len(drivers.SECTIONS) == 9


def test_every_table_of_the_drivers_has_a_plan(spark):
    whole = cli.corpus(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).select(F.col("doc_id").alias("arxiv_id"), "text", F.substring("text", 1, 40).alias("title"), F.col("text").alias("abstract"))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").limit(60)
    more = drivers.text_tables(docs) | drivers.fulltext_tables(docs) | drivers.vector_tables(rows, rows.select("vec_id", F.lit("some words here").alias("title")), k=3)
    for name, table in {**whole.tables(), **more}.items():
        assert callable(table) or table.columns, name
    for name in ("labels", "gap_topics", "silhouette", "themes", "directions"):
        more[name].collect()


def test_method_details_keep_the_patterns_order(spark):
    t = "We use the Hidden Markov algorithm. See Algorithm 2. Trained on ImageNet data. learning rate of 1e-4, batch size 32, weight decay of 0.01 and 12 layers with 8 attention heads; Adam. training took 3 days."
    r = spark.createDataFrame([(t,)], "t string").select(fulltext.method_details(F.col("t")).alias("d")).first()["d"]
    assert r["algorithms"][:2] == ["Algorithm 2", "Hidden Markov"] and "Adam" in r["algorithms"]
    assert {h["pattern"].split("\\")[0]: h["values"] for h in r["hyperparameters"]} == {"learning": ["1e-4"], "batch": ["32"], "weight": ["0.01"], "": ["8"]} or [h["values"] for h in r["hyperparameters"]] == [["1e-4"], ["32"], ["0.01"], ["8"], ["12"]]
    assert r["components"] == ["attention", "head", "layer"] and r["training"] == ["ImageNet data", "3 days"]


def test_emerging_keyword_of_a_fixture(spark):
    rows = [(f"2020-{m:02}", ["old"]) for m in range(1, 13) for _ in range(3)] + [(f"2020-{m:02}", ["new"]) for m in (10, 11, 12) for _ in range(m - 8)]
    t = {r["keyword"]: r for r in trends.keyword_trends(spark.createDataFrame(rows, "month string, keywords array<string>")).collect()}
    assert t["new"]["emerging"] and t["new"]["total"] == 9 and t["new"]["slope"] == 1.0 and not t["old"]["emerging"]


def test_citation_bridges_against_brute_force(spark):
    from itertools import permutations

    pairs = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (4, 6), (6, 7), (2, 6)]
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)

    def shortest(s, t):
        now, found = [[s]], []
        while now and not found:
            now = [[*p, n] for p in now for n in out.get(p[-1], []) if n not in p]
            found = [p for p in now if p[-1] == t]
        return found

    score = dict.fromkeys(range(1, 8), 0.0)
    for s, t in permutations(score, 2):
        paths = shortest(s, t)
        for p in paths:
            for v in p[1:-1]:
                score[v] += 1 / len(paths) / 30
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = {r["id"]: r["betweenness"] for r in graph.directed_betweenness(e).collect()}
    assert got == pytest.approx(score)
    p = spark.createDataFrame([(i, [f"c{i % 3}.x", "z.q"]) for i in score], "arxiv_id long, category_list array<string>")
    best = graph.citation_bridges(e, p).collect()
    assert all(abs(r["score"] - r["betweenness"] * (1 + 0.1 * r["diversity"])) < 1e-5 for r in best) and {r["arxiv_id"] for r in best} == {k for k, v in score.items() if v > 0}
    long = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    assert graph.is_acyclic(long) and not graph.is_acyclic(long.union(spark.createDataFrame([(30, 0)], "src long, dst long")))


def test_sota_papers_that_were(spark):
    e = spark.createDataFrame([("p", "t", "d", 1, False), ("q", "t", "d", 2, True), ("r", "t", "d", 3, False)], "arxiv_id string, task_name string, dataset_name string, rank int, was_sota boolean")
    assert {(r["arxiv_id"], r["current"]) for r in benchmarks.sota_papers(e).collect()} == {("p", True), ("q", False)}
