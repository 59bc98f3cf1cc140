"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import datetime

import duckdb
import pytest

from corvane.plans import catalog, views

assert views.keyword_trends.__name__ in catalog.QUERIES
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if isinstance(v, datetime.date | datetime.datetime | list) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        return
    r = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert got == want


def test_coauthor_queries_over_every_pair(spark):
    from collections import defaultdict
    from itertools import combinations

    teams = {r["arxiv_id"]: set(r["author_list"] or []) for r in catalog.papers(spark, SF).select("arxiv_id", "author_list").collect()}
    near = defaultdict(set)
    for team in teams.values():
        for a, b in combinations(team, 2):
            near[a].add(b)
            near[b].add(a)
    ask = lambda name: catalog.QUERIES[name](spark, SF).collect()
    assert {r["id"]: r["degree"] for r in ask("coauthor_degree_all")} == {a: len(n) for a, n in near.items()}
    stats = ask("network_stats_all")[0]
    assert (stats["nodes"], stats["edges"]) == (len(near), sum(map(len, near.values())) // 2)
    want = {i: (len(t), sum(len(near[a]) for a in t)) for i, t in teams.items() if t}
    assert {r["arxiv_id"]: (r["team_size"], r["team_connections"]) for r in ask("paper_team_metrics_all")} == want


def test_text_queries_over_all_languages(spark, tmp_path):
    import math
    import re
    from collections import Counter
    from itertools import combinations

    words = ["the hand of cora", "than verständlich gemacht werden", "fenêtre maison than that", "coco der der hand größe", "árbol sobre werden maison"]
    rows = [(i, f"{words[i % 5]} wort{'abcdefg'[i % 7]} {words[(i * 3 + 1) % 5]}", ["en", "de", "fr", None, "es"][i % 5], f"s{i % 2}", 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    ask = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    docs = {r[0]: r[1].lower() for r in rows}

    counts = Counter(w for t in docs.values() for w in re.findall(r"\b([a-z]{4,})\b", t))
    stop = {"that", "than"}
    assert {r["term"]: r["n"] for r in ask("keyword_counts_all")} == {w: n for w, n in counts.items() if w not in stop}
    found = {i: [k for k, p in catalog.LEX.items() if re.search(p, t)] for i, t in docs.items()}
    assert {r["name"]: r["n"] for r in ask("lexicon_hits_all")} == Counter(k for ks in found.values() for k in ks)
    assert {r["arxiv_id"]: r["novelty"] for r in ask("novelty_score_all")} == {i: len(ks) / 5 for i, ks in found.items()}

    terms = {i: Counter(re.findall(r"\b([a-z][a-z\-]+[a-z])\b", t)) for i, t in docs.items()}
    df = Counter(w for c in terms.values() for w in c)
    want = set()
    for i, c in terms.items():
        scores = sorted((-round(n / max(c.values()) * math.log(len(docs) / (1 + df[w])), 6), w) for w, n in c.items() if len(w) >= 3)
        want |= {(i, w) for _, w in scores[:5]}
    assert {(r["id"], r["term"]) for r in ask("tfidf_topn_all")} == want
    pairs = Counter(p for c in terms.values() for p in combinations(sorted(w for w in c if len(w) >= 3), 2))
    assert {(r["a"], r["b"]): r["n"] for r in ask("cooccurrence_all")} == {p: n for p, n in pairs.items() if n >= 3}
    assert {r["arxiv_id"] for r in ask("doc_keywords_all")} == set(docs)
