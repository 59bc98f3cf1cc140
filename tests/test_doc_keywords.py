"""Keywords of documents against a plain loop, with awkward rows, and how their words move."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corvane.operators import text

STOP, MERGES = ["the", "of-the", "zeta"], {"thth": "the", "beta": "alpha", "gamma": "data set", "omega": None}


def corpus():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "the", "thth", "of", "zeta", "omega-x", "omega", "größe", "x", "Alpha", "del"]
    few = [f"{a}{b}{c}" for a in "pqrs" for b in "aeiou" for c in "lmn"]
    line = lambda n: " ".join(rng.choice(words if rng.random() < 0.7 else few) for _ in range(n))
    rows = [(i, line(rng.randrange(4)), line(rng.randrange(200))) for i in range(30)]
    rows += [(3, "alpha delta", line(40)), (3, "pal", line(40)), (40, None, "delta omega delta omega"), (41, "title alone", None), (42, None, None), (43, "the", "the of-the thth 7"), (44, "x", "")]
    return [*rows, (None, "pal", "alpha pal"), (None, None, None), (45, "pal pal", "pal qel"), (45, "pal", "qel pal qel")]


def plain(rows, n):
    docs = {}
    for i, t, a in rows:
        if i is None:
            continue
        t, a = (t or "").lower(), (a or "").lower()
        x = f"{t} {t} {t} {a}"
        words = [w for w in re.findall(r"\b([a-z][a-z\-]+[a-z])\b", x) if w not in STOP]
        docs.setdefault(i, []).append((t, x, [c for c in (MERGES.get(w) or w for w in words) if c not in STOP]))
    out = {}
    for i, parts in docs.items():
        uni, bi = Counter(w for p in parts for w in p[2]), Counter(f"{v} {w}" for p in parts for v, w in zip(p[2], p[2][1:], strict=False))
        scores = {}
        for w, k in sorted(uni.items(), key=lambda e: (-e[1], e[0]))[:50]:
            scores[w, False] = max(k * (1 / (1 + x.find(w) / 100) * (1.0 if w in t else 0.5)) for t, x, _ in parts)
        for w, k in sorted((e for e in bi.items() if e[1] >= 2), key=lambda e: (-e[1], e[0]))[:30]:
            scores[w, True] = k * 1.5
        kept, used = [], set()
        for (w, _), _ in sorted(scores.items(), key=lambda e: (-e[1], e[0][0])):
            if len(kept) < n and not used & set(w.split(" ")):
                kept.append(w)
                used |= set(w.split(" "))
        if uni:
            out[i] = kept
    return out


def test_keywords_are_the_plain_loop_with_shared_ids_too(spark):
    for rows in (corpus(), [r for r in corpus() if r[0] not in (3, 45)]):
        df = spark.createDataFrame(rows, "key int, title string, abstract string").repartition(5)
        for n in (10, 3):
            got = text.doc_keywords(df, id_column="key", n=n, stop=STOP, merges=MERGES)
            assert got.columns == ["key", "keywords"]
            made = got.collect()
            assert len(made) == len({r["key"] for r in made})
            assert {r["key"]: r["keywords"] for r in made} == plain(rows, n)


def test_words_of_keywords_never_become_rows(spark):
    df = spark.createDataFrame(corpus(), "arxiv_id int, title string, abstract string").where("arxiv_id not in (3, 45)")
    plan = text.doc_keywords(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in plan and plan.split("== Initial Plan ==")[0].count("Exchange ") == 1
    assert not any(step in plan for step in ("Generate", "Window", "Join"))
    assert text.doc_keywords(df.where(F.lit(False))).count() == 0
