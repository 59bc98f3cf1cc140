"""Text operators: lexicon hits, keywords, TF-IDF, co-occurrence, topics, emerging terms."""

from __future__ import annotations

from collections import Counter
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import lexicon as L
from ..functions.literals import matches
from ..functions.macros import explode_pairs, small_batches, top, top_per, written

#: Borders of words of every script, the same on every Java version.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
TOKEN = rf"{BEFORE}([a-z][a-z\-]+[a-z]){AFTER}"


def hits(text: Column, lexicon: dict[str, str]) -> Column:
    """Names of the patterns found in a text, in the lexicon's order; one expression, no UDF. The text is lower-cased once, as the only element of an array."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.transform(F.array(low), lambda t: F.filter(F.array(*[F.when(matches(t, p), F.lit(k)) for k, p in lexicon.items()]), lambda x: x.isNotNull()))[0]


def methods(text: Column) -> Column:
    return hits(text, L.METHODS)


def datasets(text: Column) -> Column:
    return hits(text, L.DATASETS)


def contributions(text: Column, classes: dict[str, list[str]] | None = None) -> Column:
    return hits(text, {k: "|".join(f"(?:{p})" for p in ps) for k, ps in (classes or L.CONTRIBUTIONS).items()})


def novelty(text: Column, patterns: list[str] | None = None, full: int = 5) -> Column:
    """Share of ``full`` novelty patterns found, 1 at most."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = sum((low.rlike(p).cast("int") for p in patterns or L.NOVELTY), F.lit(0))
    return F.least(n / float(full), F.lit(1.0))


def analyze(papers: DataFrame, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """The per-paper text columns: methods, data sets, contributions, scores and flags."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))
    low = F.lower(text)
    out = papers.withColumns({"methods_detected": methods(text), "datasets_mentioned": datasets(text), "contribution_types": contributions(text), "novelty_score": novelty(text)})
    has = lambda c: F.array_contains("contribution_types", c)
    return out.withColumns({
        "methods_count": F.size("methods_detected"), "datasets_count": F.size("datasets_mentioned"), "primary_contribution": F.try_element_at("contribution_types", F.lit(1)),
        "has_theoretical_contribution": has("theoretical"), "has_empirical_contribution": has("empirical_study"), "is_survey_paper": has("survey"), "is_application_paper": has("application"),
        "claims_sota": low.rlike(r"\bstate-of-the-art|sota\b"), "has_code_mention": low.rlike(r"\bcode\b|\bgithub\b|\bimplementation\b"),
    })


def tokens(docs: DataFrame, text: str | Column, id_column: str = "arxiv_id", least: int = 3, pattern: str = TOKEN) -> DataFrame:
    """(id, pos, term): words of a text, hyphens inside allowed."""
    t = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(pattern), F.lit(1))
    return docs.select(F.col(id_column).alias("id"), F.posexplode(found).alias("pos", "term")).where(F.length("term") >= least)


def _vocab(df: DataFrame, words) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(w,) for w in sorted(set(words))], "term string"))  # a word list


def normalise(toks: DataFrame, stop: list[str] = (), merges: dict[str, str] | None = None) -> DataFrame:
    """Leave filter words out, replace variants by their canonical term, and leave filter words out again."""
    out = toks.join(_vocab(toks, stop), "term", "left_anti") if stop else toks
    if merges:
        m = F.broadcast(toks.sparkSession.createDataFrame(sorted(merges.items()), "term string, canonical string"))  # a synonym list
        out = out.join(m, "term", "left").withColumn("term", F.coalesce("canonical", "term")).drop("canonical")
        out = out.join(_vocab(toks, stop), "term", "left_anti") if stop else out
    return out


def process_keywords(rows: DataFrame, stop: list[str] = (), patterns: list[str] = (), merges: dict[str, str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted lists of terms (by, term, score): unwanted terms go, variants become their canonical term, which goes too if it is
    unwanted, and scores add up. A pattern filters terms that begin with it. Terms are lower-cased; null terms go.
    """
    def kept(df: DataFrame) -> DataFrame:
        for p in patterns:
            df = df.where(~F.col("term").rlike(f"^(?:{p})"))
        return df.join(_vocab(df, [w.lower() for w in stop]), "term", "left_anti") if stop else df

    out = kept(rows.where("term is not null").withColumn("term", F.lower("term")))
    if merges:
        m = F.broadcast(rows.sparkSession.createDataFrame(sorted({k.lower(): v.lower() for k, v in merges.items()}.items()), "term string, canonical string"))  # a synonym list
        out = kept(out.join(m, "term", "left").withColumn("term", F.coalesce("canonical", "term")).drop("canonical"))
    return out.groupBy(*by, "term").agg(F.sum("score").alias("score"))


def keyword_counts(docs: DataFrame, text: str | Column, id_column: str = "arxiv_id", candidates: int = 200, n: int = 50, stop: list[str] | None = None) -> DataFrame:
    """Most frequent words of four letters and more, the stop words taken out of the first ``candidates``."""
    t = tokens(docs, text, id_column, 4, rf"{BEFORE}([a-z]{{4,}}){AFTER}")
    first = top(t.groupBy("term").agg(F.count(F.lit(1)).alias("n")), candidates, F.desc("n"), F.asc("term"))
    return top(first.join(_vocab(first, L.SIMPLE_STOP_WORDS if stop is None else stop), "term", "left_anti"), n, F.desc("n"), F.asc("term"))


def family_counts(docs: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """All occurrences of each matched word of regular expression families."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(p), F.lit(1)) for p in patterns]))
    return docs.select(F.explode(found).alias("match")).groupBy("match").agg(F.count(F.lit(1)).alias("n"))


def frequency(papers: DataFrame, array: str, n: int = 50) -> DataFrame:
    return top(papers.select(F.explode(array).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")), n, F.desc("n"), F.asc("name"))


def document_counts(docs: DataFrame, text: str | Column, id_column: str = "arxiv_id", keep: tuple[str, ...] = (), least: int = 3, pattern: str = TOKEN) -> DataFrame:
    """(id, keep, terms): the words of each document with their counts, as array<struct<term, tf>>; a written table, a row for each id and keep.

    Words are sorted and counted where their text lies; only the words of rows that share id and keep are brought together first. Rows without an id are left out.
    """
    t = F.col(text) if isinstance(text, str) else text
    found = F.filter(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(pattern), F.lit(1)), lambda w: F.length(w) >= least)
    keys = ["id", *keep]
    named = docs.select(F.col(id_column).alias("id"), *keep, found.alias("words")).where("id is not null")
    twice = written(named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if not twice.isEmpty():
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        other = twice.select(*[F.col(k).alias(f"__{k}") for k in keys])
        several = named.join(other, same, "left_semi").groupBy(*keys).agg(F.flatten(F.collect_list("words")).alias("words"))
        named = named.join(other, same, "left_anti").unionByName(several)
    # What a lambda's variable holds is made once; as an expression it would be made again for each word.
    once = lambda value, f: F.transform(F.array(value), f)[0]
    heads = lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x.alias("term"), i.alias("at"))), lambda h: (h["at"] == 0) | (h["term"] != F.get(s, h["at"] - 1)))
    ends = lambda s, h: once(F.transform(h, lambda x: x["at"]), lambda at: F.transform(h, lambda x, i: F.struct(x["term"].alias("term"), (F.coalesce(F.get(at, i + 1), F.size(s)) - x["at"]).cast("long").alias("tf"))))
    return written(named.select(*keys, once(F.sort_array("words"), lambda s: once(heads(s), lambda h: ends(s, h))).alias("terms")))


#: Different terms up to which their table is sent to every task.
BROADCAST_TERMS = 400_000
#: Documents whose terms one task ranks.
TASK_DOCUMENTS = 2_000


def tfidf(counts: DataFrame, total: DataFrame | None = None, n: int = 20) -> DataFrame:
    """Top terms of each document by tf / max tf * ln(N / (1 + df)); not clipped. counts: (id, terms), as of ``document_counts``, or words (id, term).

    total: one row, the documents counted. With a vocabulary of bounded size only the counts are shuffled, once.
    """
    if "terms" not in counts.columns:
        tf = counts.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
        counts = written(tf.where("id is not null").groupBy("id").agg(F.collect_list(F.struct("term", "tf")).alias("terms")))
    counts = counts.where(F.size("terms") > 0)
    df = written(counts.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    docs = total if total is not None else counts.agg(F.count(F.lit(1)).alias("total"))
    # So many documents that a task's terms stay as many at every size; a document is in one task, which ranks its terms.
    tasks = max(counts.sparkSession.sparkContext.defaultParallelism, counts.count() // TASK_DOCUMENTS + 1)
    rows = counts.repartition(tasks, "id").select("id", F.array_max("terms.tf").alias("most"), F.explode("terms").alias("x")).select("id", "x.term", "x.tf", "most")
    out = rows.join(F.broadcast(df) if df.count() <= BROADCAST_TERMS else df, "term").crossJoin(F.broadcast(docs))
    score = F.col("tf") / F.col("most") * F.log(F.col("total") / (1 + F.col("df")))
    return top_per(out.select("id", "term", F.round(score, 6).alias("score")), ["id"], n, F.desc("score"), F.asc("term"))


def cooccurrence(toks: DataFrame, words: int = 300, least: int = 3) -> DataFrame:
    """Pairs of the most frequent words by the documents that hold both; the vocabulary bounds the pairs of a document."""
    sets = toks.select("id", "term").distinct()
    vocab = top(sets.groupBy("term").agg(F.count(F.lit(1)).alias("n")), words, F.desc("n"), F.asc("term")).select("term")
    held = sets.join(F.broadcast(vocab), "term").groupBy("id").agg(F.collect_set("term").alias("terms"))
    return explode_pairs(held, "terms").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def topics(toks: DataFrame, n_topics: int = 20, words: int = 300, near: int = 15, members: int = 5, least: int = 3) -> DataFrame:
    """Greedy topics: each frequent word still unused with its closest unused companions (a driver loop over the vocabulary)."""
    freq = top(toks.select("id", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n")), words, F.desc("n"), F.asc("term"))
    pairs = cooccurrence(toks, words, least)
    sym = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    close: dict[str, list[str]] = {}
    for r in top_per(sym, ["a"], near, F.desc("n"), F.asc("b")).orderBy("a", F.desc("n"), "b").collect():  # words * near rows
        close.setdefault(r["a"], []).append(r["b"])
    used: set[str] = set()
    rows = []
    for r in freq.collect():
        if r["term"] in used or len(rows) >= n_topics:
            continue
        own = [w for w in close.get(r["term"], []) if w not in used][:members]
        if own:
            rows.append((len(rows), r["term"], own, r["n"]))
            used |= {r["term"], *own}
    schema = T.StructType([T.StructField("topic", T.IntegerType()), T.StructField("head", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("n", T.LongType())])
    return toks.sparkSession.createDataFrame(rows, schema)


def emerging(toks: DataFrame, least: int = 5, growth: float = 1.5, new_rank: float = 100, n: int = 50) -> DataFrame:
    """Terms whose share of documents grew between the halves of the active periods; toks: (id, term, period), or (id, period, terms) as of ``document_counts``.

    The latter holds each document's terms once, so that no task has to hold the pairs of documents and terms to tell them apart.
    """
    if "terms" in toks.columns:
        own = toks.where(F.size("terms") > 0)
        d, toks = own.select("id", "period", F.explode("terms.term").alias("term")), own.select("id", "period")
    else:
        d = toks.select("id", "term", "period").distinct()
    periods = toks.select("period").distinct().withColumn("i", F.row_number().over(W.orderBy("period")) - 1)  # calendar periods: few
    total = periods.agg(F.count(F.lit(1)).alias("m"))
    side = F.broadcast(periods.crossJoin(F.broadcast(total)).select("period", (F.col("i") >= F.floor(F.col("m") / 2)).alias("late")))
    d = d.join(side, "period")
    size = toks.join(side, "period").select("id", "late").distinct().agg(F.greatest(F.count_if(~F.col("late")), F.lit(1)).alias("e_docs"), F.greatest(F.count_if("late"), F.lit(1)).alias("l_docs"))
    c = d.groupBy("term").agg(F.count_if(~F.col("late")).alias("early"), F.count_if("late").alias("late_n")).where(F.col("late_n") >= least).crossJoin(F.broadcast(size))
    g = (F.col("late_n") / F.col("l_docs")) / F.nullif(F.col("early") / F.col("e_docs"), F.lit(0.0))
    c = c.withColumn("g", g).where(F.col("g").isNull() | (F.col("g") > growth))
    rank = F.col("late_n") * F.coalesce("g", F.lit(float(new_rank)))
    return top(c.select("term", "early", F.col("late_n").alias("late"), F.round("g", 4).alias("growth"), F.col("g").isNull().alias("is_new"), F.round(rank, 4).alias("rank")), n, F.desc("rank"), F.asc("term"))


#: Bytes of texts that Python gets at once.
ARROW_BYTES = 4_000_000


def keywords(rows: list[tuple[str, str, list[str]]], n: int = 10) -> list[str]:
    """Keywords of (title, text, words) rows that make one document: the 50 most frequent words and 30 most frequent pairs of neighbours, in order of their scores."""
    often = lambda held, most: sorted(held, key=lambda x: (-x[1], x[0]))[:most]
    words, pairs = Counter(), Counter()
    for _, _, own in rows:
        words.update(own)
        pairs.update(map(" ".join, pairwise(own)))
    single, double = often(words.items(), 50), often((x for x in pairs.items() if x[1] >= 2), 30)
    scored = [(-1.5 * tf, term) for term, tf in double]
    for title, text, _ in rows:
        scored += [(-tf * (1 / (1 + text.find(term) / 100.0) * (1.0 if term in title else 0.5)), term) for term, tf in single]
    kept, used = [], set()
    for _, term in sorted(scored):
        if used.isdisjoint(parts := term.split(" ")):
            kept.append(term)
            used.update(parts)
        if len(kept) >= n:
            break
    return kept


def doc_keywords(docs: DataFrame, title: str = "title", abstract: str = "abstract", id_column: str = "arxiv_id", n: int = 10, stop: list[str] = (), merges: dict[str, str] | None = None) -> DataFrame:
    """Keywords of each document: unigrams by tf and position, bigrams (tf >= 2) at 1.5, greedily without shared words.

    A text is shuffled once, to deal the texts evenly; its words are cut, counted and scored in one task and never become rows. Rows
    that share an id make one document: counts add up, pairs lie within a row, a term has its best score. Rows without an id or without words are left out.
    """
    unwanted, canonical = frozenset(stop), {k: v for k, v in (merges or {}).items() if v is not None}
    kinds = T.StructType([T.StructField(id_column, docs.select(id_column).schema[0].dataType), T.StructField("keywords", T.ArrayType(T.StringType()))])
    ids, out = kinds.names

    def normal(words: list[str]) -> list[str]:
        kept = [w for w in words if w not in unwanted]
        return [c for w in kept if (c := canonical.get(w, w)) not in unwanted] if canonical else kept

    def work(batches):
        for batch in batches:
            held = []
            for rows in batch.column(1).to_pylist():
                parts = [(r["t"], f"{r['t']} {r['t']} {r['t']} {r['a']}", normal(r["words"].split())) for r in rows]
                held.append(keywords(parts, n) if any(p[2] for p in parts) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.string()))], names=[ids, out])

    small_batches(docs.sparkSession, ARROW_BYTES)
    named = docs.select(F.col(id_column).alias("id"), F.lower(F.coalesce(title, F.lit(""))).alias("t"), F.lower(F.coalesce(abstract, F.lit(""))).alias("a")).where("id is not null")
    twice = written(named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    found = F.regexp_extract_all(F.concat_ws(" ", "t", "t", "t", "a"), F.lit(TOKEN), F.lit(1))
    # Words hold no spaces, so they go to Python as one string. Dealt by id: a table's files can be fewer than the cores; adaptive
    # execution would make as many tasks as cores of them, which end at different times.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    row = F.struct("t", "a", F.array_join(found, " ").alias("words"))
    one = named.repartition(tasks, "id").select("id", F.array(row).alias("rows"))
    if not twice.isEmpty():
        several = named.join(twice, "id", "left_semi").select("id", row.alias("row")).groupBy("id").agg(F.collect_list("row").alias("rows"))
        one = named.join(twice, "id", "left_anti").repartition(tasks, "id").select("id", F.array(row).alias("rows")).unionByName(several)
    return one.mapInArrow(work, kinds).where(F.col(out).isNotNull())
