"""Hand-computed cases of the shared expressions and operators."""

import datetime
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from corvane.functions import lexicon, macros, ranks
from corvane.operators import fulltext, graph, neighbours, text, vectors
from corvane.sources import readers, service, sinks


def test_gini(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 0), ("a", 10), ("b", 5), ("b", 5)], "g string, v int")
    got = {r["g"]: r["gini"] for r in ranks.gini(df, ["g"], "v").collect()}
    assert got == {"a": 0.75, "b": 0.0}
    assert {r["gini"] for r in ranks.gini(df, ["g"], "v", "reference").collect()} == {0.0}


def test_h_index_and_constant_fit(spark):
    df = spark.createDataFrame([("a", v) for v in (10, 8, 5, 4, 3)], "g string, v int")
    assert ranks.h_index(df, ["g"], "v").first()["h_index"] == 4
    flat = spark.createDataFrame([("a", i, 3) for i in range(4)], "g string, x int, y int")
    assert flat.groupBy("g").agg(macros.r2("y").alias("r")).first()["r"] == 0


def test_pairs_leave_repeats_and_nulls_out(spark):
    df = spark.createDataFrame([(["b", "a", "a", None],), ([],), (None,)], "arr array<string>")
    assert [tuple(r) for r in macros.explode_pairs(df, "arr").collect()] == [("a", "b")]


def test_sections(spark):
    body = "My Title\nAbstract\ntext a\n1. Introduction\ntext b\n3 Method\ntext c\n5.1 Limitations\nOur method fails to scale.\nConclusion\ntext d\nReferences\n[1] x"
    docs = spark.createDataFrame([("p", body)], "arxiv_id string, text string")
    secs = fulltext.sections(docs)
    assert [r["section"] for r in secs.orderBy("ord").collect()] == ["preamble", "abstract", "introduction", "methods", "limitations", "conclusion", "references"]
    lim = fulltext.limitations(docs, secs).first()
    assert lim["has_section"] and "scalability" in lim["themes"]


def test_lexicons_and_coauthors(spark):
    assert (len(lexicon.METHODS), len(lexicon.DATASETS), sum(map(len, lexicon.CONTRIBUTIONS.values())), len(lexicon.NOVELTY)) == (85, 43, 54, 11)
    df = spark.createDataFrame([("1", "We propose a new transformer architecture using attention mechanisms.", ["Alice", "Bob"]), ("2", None, ["Alice", "Charlie"])], "arxiv_id string, abstract string, author_list array<string>")
    rows = {r["arxiv_id"]: r for r in text.analyze(df.withColumn("title", F.lit(None).cast("string"))).collect()}
    assert rows["1"]["methods_detected"] == ["transformer", "attention"] and rows["1"]["primary_contribution"] == "new_method"
    assert rows["2"]["methods_detected"] == [] and rows["2"]["primary_contribution"] is None
    assert graph.coauthor_edges(df).count() == 2


def test_components_pagerank_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 9), (9, 10)], "a long, b long")
    assert {r["id"]: r["component"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7}
    d = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long")
    assert abs(graph.pagerank(d).agg(F.sum("pagerank")).first()[0] - 1) < 1e-9
    assert not graph.is_acyclic(d) and graph.is_acyclic(d.where("src <> 3"))
    path = graph.betweenness(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))
    assert {r["id"]: r["betweenness"] for r in path.collect()} == {1: 0.0, 2: 1.0, 3: 0.0}
    assert [r["clique"] for r in graph.maximal_cliques(spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "a long, b long")).collect()] == [[1, 2, 3]]


FEED = b"""<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2301.00001v1</id><title>A  Title</title>
<summary>Text</summary><published>2023-01-01T00:00:00Z</published><author><name>John</name></author><author><name>Jane</name></author><category term="cs.AI"/><category term="cs.LG"/>
<arxiv:primary_category term="cs.AI"/><arxiv:comment>12 pages, 3 figures. Accepted at ICML 2023</arxiv:comment></entry></feed>"""


def fake_fetch(url):
    return FEED


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "f.xml").write_bytes(FEED)
    p = readers.atom(spark, str(tmp_path / "f.xml"))
    r = p.withColumns(readers.comment_fields(F.col("arxiv_comment"))).first()
    assert (r["arxiv_id"], r["title"], r["author_list"], r["category_list"], r["published_date"]) == ("2301.00001", "A Title", ["John", "Jane"], ["cs.AI", "cs.LG"], datetime.date(2023, 1, 1))
    assert (r["page_count"], r["figure_count"], r["table_count"], r["accepted_venue"]) == (12, 3, None, "ICML 2023")
    assert r["pdf_url"].endswith("2301.00001v1.pdf")
    chunks = readers.date_chunks(spark, "2020-01-01", "2024-01-01", 12).orderBy("chunk_start").collect()
    assert len(chunks) >= 3 and str(chunks[0]["chunk_start"]) == "2020-01-01" and str(chunks[-1]["chunk_end"]) == "2024-01-01"
    assert list(service.parse(FEED, "cs.AI"))[0][0] == "2301.00001"
    sinks.dataset(p, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/papers_csv")).first()["author_list"] == "John; Jane"
    assert "<td>2301.00001</td>" in sinks.report("R", {"p": p.select("arxiv_id")}, kind="html")


def test_stream(spark, tmp_path):
    from corvane.streaming import papers as st

    rows = spark.createDataFrame([("1", datetime.datetime(2023, 1, 1)), ("1", datetime.datetime(2023, 1, 1)), ("2", datetime.datetime(2023, 1, 2))], "id string, at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    st.drain(st.stream(spark, str(tmp_path / "in"), rows.schema, "at", key="id"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_neighbours_are_exact_and_whole_at_every_size(spark, monkeypatch):
    m = np.random.default_rng(5).normal(size=(20_050, 24))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(m.tolist())), "vec_id long, embedding array<double>")
    want = [1 - np.sort(np.delete(unit @ unit[i], i))[-10:].mean() for i in range(0, len(m), 50)]
    for size in (64_000_000, 3_000_000):  # one broadcast and several
        monkeypatch.setattr(vectors, "CHUNK_BYTES", size, raising=False)
        got = {r["vec_id"]: r["isolation"] for r in vectors.isolation(df).collect()}
        assert len(got) == len(m) and np.abs(np.array([got[i] for i in range(0, len(m), 50)]) - want).max() < 1e-4


def test_neighbours_of_equal_zero_and_null_vectors(spark):
    df = spark.createDataFrame([(4, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0]), (2, [1.0, 0.0]), (5, [0.0, 0.0]), (6, None)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(vectors.neighbours(df, 4).collect(), key=lambda r: (r["id"], r["distance"] is None, r["distance"], r["other"])):
        got[r["id"]].append((r["other"], r["distance"]))
    assert got[1] == [(2, 0.0), (4, 0.0), (3, 1.0), (5, None)]
    assert got[3] == [(1, 1.0), (2, 1.0), (4, 1.0), (5, None)]
    assert got[5] == [(1, None), (2, None), (3, None), (4, None)]
    assert {r["vec_id"]: r["isolation"] for r in vectors.isolation(df, 3).collect()} == {1: 0.3333, 2: 0.3333, 3: 1.0, 4: 0.3333, 5: None, 6: None}
