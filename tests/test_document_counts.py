"""Words counted where their text lies, against plain counters, and what is made of them."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from corvane.operators import text


def corpus():
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma-ray", "delta", "of", "x", "omega"]
    rows = [(i, rng.choice("pq"), " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(40)]
    return [*rows, (3, "p", "alpha alpha zeta"), (3, "q", "beta"), (50, "p", None), (51, None, "delta delta"), (51, None, "omega delta"), (None, "p", "alpha")]


def test_counts_of_documents_that_share_ids_too(spark):
    df = spark.createDataFrame(corpus(), "arxiv_id int, period string, abstract string")
    plain = {}
    for i, p, t in corpus():
        if i is not None:
            plain.setdefault((i, p), Counter()).update(w for w in (t or "").split() if len(w) >= 3)
    made = text.document_counts(df, "abstract", keep=("period",)).collect()
    assert len(made) == len(plain)
    assert {(r["id"], r["period"]): {x["term"]: x["tf"] for x in r["terms"]} for r in made} == plain


def test_top_terms_and_emerging_terms_from_counts(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "arxiv_id int, period string, abstract string")
    plain = {}
    for i, _, t in corpus():
        if i is not None:
            plain.setdefault(i, Counter()).update(w for w in (t or "").split() if len(w) >= 3)
    plain = {i: c for i, c in plain.items() if c}
    of = Counter(w for c in plain.values() for w in c)
    want = set()
    for i, c in plain.items():
        want |= {(i, w, -s) for s, w in sorted((-round(n / max(c.values()) * math.log(len(plain) / (1 + of[w])), 6), w) for w, n in c.items())[:2]}
    counts = text.document_counts(df, "abstract")
    for most in (400_000, 0):
        monkeypatch.setattr(text, "BROADCAST_TERMS", most)
        for source in (counts, text.tokens(df.where("arxiv_id is not null"), "abstract")):
            assert {(r["id"], r["term"], round(r["score"], 6)) for r in text.tfidf(source, n=2).collect()} == {(i, w, round(s, 6) + 0.0) for i, w, s in want}
    same = df.where("arxiv_id is not null")
    toks = text.tokens(same.where("period = 'p'"), "abstract").withColumn("period", F.lit("p")).unionByName(text.tokens(same.where("period = 'q'"), "abstract").withColumn("period", F.lit("q")))
    ask = lambda rows: sorted(map(tuple, text.emerging(rows, least=1, growth=0.1).collect()))
    assert ask(text.document_counts(same.where("period is not null"), "abstract", keep=("period",))) == ask(toks)
