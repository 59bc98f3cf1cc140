"""Strings that a text must hold before an expression is tried on it."""

import re

from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions.literals import needed
from corvane.operators import fulltext, text


def test_strings_of_patterns():
    assert needed(r"\bbatch normali[sz]ation\b") == ("batch normali",)
    assert set(needed(r"\b(?:gan|generative adversarial)s?\b")) >= {"gan"} or needed(r"\b(?:gan|generative adversarial)s?\b") == ("an", "enerative adversarial")
    assert needed(r"(?:ab)?c+d") == ("c",) or needed(r"(?:ab)?c+d") == ("d",)
    assert needed(r"\w+") is None and needed("(?:a|\\d)") is None and needed(r"\p{L}x") is None
    every = [*L.METHODS.values(), *L.DATASETS.values(), *L.LIMITATION_MENTIONS, *L.FUTURE_MENTIONS]
    assert sum(needed(p) is None for p in every) == 0


def test_hits_and_contexts_as_by_the_expressions_alone(spark):
    said = ["Our  Model has several LIMITATIONS; it remains an open problem.", "We cannot use BERT, GANs or gpt-3 in Few-Shot learning", "In the future work, we will extend it", "", None, "gang of adamant berts", "no match\nhere", "batch normalisation and self-attention, fine-tuning"]
    df = spark.createDataFrame(list(enumerate(said)), "k int, text string")
    for lexicon in (L.METHODS, L.DATASETS, L.LIMITATION_THEMES):
        got = {r["k"]: r["h"] for r in df.select("k", text.hits(F.col("text"), lexicon).alias("h")).collect()}
        assert got == {i: [n for n, p in lexicon.items() if re.search(p, (t or "").lower())] for i, t in enumerate(said)}
    for patterns in (L.LIMITATION_MENTIONS, L.FUTURE_MENTIONS):
        got = {r["k"]: r["m"] for r in df.select("k", fulltext.mentions(F.col("text"), patterns, 5, 5).alias("m")).collect()}
        for i, t in enumerate(said):
            around = [re.sub(r"\s+", " ", t[max(0, m.start() - 5) : m.end() + 5]).strip() for p in patterns for m in re.finditer(p, t or "", re.I)]
            assert got[i] == list(dict.fromkeys(a for a in around if a))
