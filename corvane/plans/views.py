"""More registered queries: keyword trends, buckets, derived columns, simple and view scores, author and benchmark summaries, citation graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import authors, benchmarks, fulltext, gaps, graph, impact, stats, text, trends, vectors
from ..sources.adapters import SOTA_SQL, papers, read, sota
from .catalog import _CHAIN, _TOK, NOW, A, P, _chain, _documents, _named_sql, query

# --- trends -----------------------------------------------------------------------------------------------------------
_KEYWORDS = f"""{P}, ms AS (SELECT DISTINCT month FROM papers WHERE month IS NOT NULL), mr AS (SELECT month, row_number() OVER (ORDER BY month) AS i, count(*) OVER () AS m FROM ms),
cut AS (SELECT min(month) AS cutoff FROM mr WHERE m < 4 OR i > m - ceil(m / 4)), s AS (SELECT keyword, month, count(*) AS k FROM (SELECT unnest(methods[1:5]) AS keyword, month FROM papers WHERE month IS NOT NULL) GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY month) - 1 AS x FROM s),
g AS (SELECT keyword, CAST(sum(k) AS BIGINT) AS total, count(*) AS periods, round(coalesce(regr_slope(k, x), 0), 4) AS slope, min(month) AS first_seen, max(month) AS last_seen FROM x GROUP BY keyword),
t AS (SELECT g.*, first_seen >= cutoff AND slope > 0 AS emerging FROM g, cut WHERE total >= 5 AND periods >= 2)"""


@query(f"{_KEYWORDS} SELECT * FROM t")
def keyword_trends(spark, d):
    return trends.keyword_trends(papers(spark, d), "methods")


@query(f"{_KEYWORDS} SELECT * FROM t WHERE emerging ORDER BY total DESC, keyword LIMIT 30")
def emerging_keywords(spark, d):
    return trends.emerging_keywords(trends.keyword_trends(papers(spark, d), "methods"))


@query("""WITH n AS (SELECT lower(text) AS t, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q FROM documents JOIN orders ON doc_id = o_orderkey),
qs AS (SELECT list_sort(list(DISTINCT q)) AS l FROM n), p AS (SELECT q >= l[-2] AS late, unnest(regexp_extract_all(t, '[a-z]{4,}')) AS word FROM n, qs WHERE len(l) >= 4 AND q >= l[-4]),
c AS (SELECT word, count(*) FILTER (WHERE late) AS recent, count(*) FILTER (WHERE NOT late) AS earlier FROM p GROUP BY word),
h AS (SELECT * FROM c WHERE recent > 0 ORDER BY recent DESC, word LIMIT 100), g AS (SELECT *, round((recent - earlier) / nullif(CAST(earlier AS DOUBLE), 0), 4) AS growth FROM h)
SELECT * FROM g WHERE growth > 0.5 OR (growth IS NULL AND recent >= 10) ORDER BY growth DESC NULLS FIRST, word LIMIT 20""")
def emerging_words(spark, d):
    dates = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("published_date"))
    return trends.emerging_words(read(spark, d, "documents").join(dates, "doc_id"), F.col("text"), pattern="[a-z]{4,}")


# --- impact -----------------------------------------------------------------------------------------------------------
_BEST_H = f"""{A}, h AS (SELECT author, count(*) FILTER (WHERE y >= rn) AS h FROM (SELECT author, y, row_number() OVER (PARTITION BY author ORDER BY y DESC) AS rn FROM a) GROUP BY author),
b AS (SELECT arxiv_id, max(h) AS max_h FROM a JOIN h USING (author) GROUP BY arxiv_id)"""


@query(f"""{_BEST_H} SELECT CASE WHEN max_h <= 5 THEN '0-5' WHEN max_h <= 15 THEN '6-15' WHEN max_h <= 30 THEN '16-30' WHEN max_h <= 50 THEN '31-50' ELSE '50+' END AS bucket, count(*) AS n, round(avg(y), 4) AS avg_citations, median(y) AS median_citations
FROM (SELECT max_h, CAST(coalesce(citations, 0) AS DOUBLE) AS y FROM papers JOIN b USING (arxiv_id)) GROUP BY 1""")
def hindex_buckets(spark, d):
    p = papers(spark, d)
    return impact.buckets(p.join(authors.best_h(p), "arxiv_id"), F.col("max_h"), impact.H_BUCKETS, "50+")


@query(f"""{P}, r AS (SELECT CAST(coalesce(citations, 0) AS DOUBLE) AS y, unnest([{{'feature': 'authors', 'v': CAST(coalesce(len(author_list), 0) AS DOUBLE)}}, {{'feature': 'has_code', 'v': CAST(has_code AS DOUBLE)}}, {{'feature': 'labels', 'v': CAST(coalesce(len(category_list), 0) AS DOUBLE)}}]) AS s FROM papers),
g AS (SELECT s.feature AS feature, sum(CASE WHEN y > 100 THEN s.v ELSE 0 END) / greatest(count(*) FILTER (WHERE y > 100), 1) AS high, sum(CASE WHEN y > 100 THEN 0 ELSE s.v END) / greatest(count(*) FILTER (WHERE NOT y > 100), 1) AS low FROM r GROUP BY 1)
SELECT feature, round(high, 4) AS high, round(low, 4) AS low, round(high / low, 4) AS multiplier FROM g WHERE low > 0""")
def simple_impact(spark, d):
    size = lambda c: F.size(F.coalesce(c, F.array()))
    return impact.simple_impact(papers(spark, d), {"authors": size("author_list"), "has_code": F.col("has_code"), "labels": size("category_list")}, more_than=100)


# --- statistics -------------------------------------------------------------------------------------------------------
@query(f"""{P}, z AS (SELECT arxiv_id, coalesce(velocity, 0) AS v, has_code AS a, is_survey AS b, contains(lower(venue), 'urgent') OR contains(lower(venue), 'high') AS top,
  CASE WHEN len(category_list) > 1 THEN len(list_distinct(list_transform(category_list, lambda x: string_split(x, '#')[1]))) ELSE 0 END AS k FROM papers)
SELECT arxiv_id, row_number() OVER (ORDER BY v DESC, arxiv_id) AS velocity_rank, round(100 * (1 - row_number() OVER (ORDER BY v DESC, arxiv_id) / CAST(count(*) OVER () AS DOUBLE)), 1) AS velocity_percentile,
  CAST(k AS INTEGER) AS interdisciplinary, top AS is_top_venue, CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(top AS INTEGER) AS quality_signals FROM z""")
def derived_metrics(spark, d):
    return stats.derive(papers(spark, d), [F.col("has_code"), F.col("is_survey")], venues=["urgent", "high"], separator="#")


@query(f"{P} SELECT arxiv_id, primary_category, coalesce(citations, 0) AS citations FROM papers WHERE list_contains(category_list, 'Brand#23') ORDER BY citations DESC, arxiv_id LIMIT 15")
def top_in_category(spark, d):
    return stats.top_in_category(papers(spark, d), "Brand#23")


@query("SELECT doc_id AS arxiv_id, n_chars AS citations FROM documents WHERE contains(lower(text), 'the') ORDER BY n_chars DESC, doc_id LIMIT 20")
def keyword_search(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("arxiv_id"), "text", F.col("n_chars").alias("citations"))
    return stats.search(docs, F.col("text"), "THE")


@query(f"""{P}, s AS (SELECT primary_category, count(*) AS n, round(avg(coalesce(citations, 0)), 4) AS avg_citations, round(avg(CAST(has_code AS DOUBLE)), 4) AS code_rate, round(avg(coalesce(len(author_list), 0)), 4) AS avg_team FROM papers WHERE primary_category IS NOT NULL GROUP BY 1),
u AS (SELECT primary_category, count(DISTINCT a) AS authors FROM (SELECT primary_category, unnest(author_list) AS a FROM papers) GROUP BY 1) SELECT s.*, coalesce(authors, 0) AS authors FROM s LEFT JOIN u USING (primary_category)""")
def by_category(spark, d):
    return stats.by_category(papers(spark, d))


@query(f"""{P}, l AS (SELECT arxiv_id, unnest([{{'l': 'cited', 'o': true, 'k': CAST(citations AS DOUBLE)}}, {{'l': 'influential', 'o': citations > 100, 'k': CAST(len(author_list) AS DOUBLE)}}, {{'l': 'velocity', 'o': true, 'k': velocity}},
 {{'l': 'code', 'o': has_code, 'k': CAST(citations AS DOUBLE)}}, {{'l': 'venue', 'o': venue = '1-URGENT', 'k': CAST(citations AS DOUBLE)}}, {{'l': 'interdisciplinary', 'o': true, 'k': CAST(len(category_list) AS DOUBLE)}}]) AS s FROM papers)
SELECT s.l AS list, arxiv_id, s.k AS key FROM l WHERE s.o AND s.k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s.l ORDER BY s.k DESC, arxiv_id) <= 100""")
def six_top_lists(spark, d):
    there, cited = F.col("citations").isNotNull(), F.col("citations")
    team, labels = (F.when(F.col(c).isNotNull(), F.size(c)) for c in ("author_list", "category_list"))
    lists = {"cited": (there, cited), "influential": ((cited > 100) & team.isNotNull(), team), "velocity": (F.col("velocity").isNotNull(), F.col("velocity")), "code": (F.col("has_code") & there, cited), "venue": ((F.col("venue") == "1-URGENT") & there, cited), "interdisciplinary": (labels.isNotNull(), labels)}
    return stats.top_lists(papers(spark, d), lists)


# --- gaps -------------------------------------------------------------------------------------------------------------
@query(f"""{P}, p AS (SELECT arxiv_id, unnest(category_list) AS c FROM papers), z AS (SELECT c, count(*) AS size FROM p GROUP BY c),
q AS (SELECT a.c AS cat1, b.c AS cat2, count(*) AS actual FROM p a JOIN p b ON a.arxiv_id = b.arxiv_id AND a.c < b.c GROUP BY ALL),
e AS (SELECT q.*, x.size * y.size / CAST((SELECT count(*) FROM papers) AS DOUBLE) AS e FROM q JOIN z x ON x.c = cat1 JOIN z y ON y.c = cat2)
SELECT cat1, cat2, actual, round(e, 1) AS expected, round((e - actual) / e, 4) AS score FROM e WHERE e > 10 AND actual < 0.95 * e ORDER BY score DESC, cat1, cat2 LIMIT 15""")
def simple_pair_gaps(spark, d):
    return gaps.simple_pair_gaps(papers(spark, d), factor=0.95)


@query(f"""{P}, s AS (SELECT primary_category, count(*) AS n, count(*) FILTER (WHERE is_survey) AS surveys FROM papers WHERE primary_category IS NOT NULL GROUP BY 1 ORDER BY n DESC, primary_category LIMIT 20)
SELECT * FROM s WHERE n > 50 AND surveys < 0.2 * n ORDER BY n DESC, primary_category LIMIT 10""")
def simple_survey_gaps(spark, d):
    return gaps.simple_survey_gaps(papers(spark, d), F.col("is_survey"), rate=0.2)


@query(f"""{P}, mr AS (SELECT month, row_number() OVER (ORDER BY month) AS i, count(*) OVER () AS m FROM (SELECT DISTINCT month FROM papers WHERE month IS NOT NULL)), cut AS (SELECT min(month) AS since FROM mr WHERE i > m - ceil(m / 4)),
s AS (SELECT primary_category, count(*) AS n, coalesce(avg(coalesce(velocity, 0)) FILTER (WHERE coalesce(citations, 0) > 0), 0) AS v, avg(CASE WHEN month >= since THEN 1.0::DOUBLE ELSE 0 END) AS r, avg(coalesce(citations, 0)) AS c FROM papers, cut WHERE primary_category IS NOT NULL GROUP BY 1)
SELECT primary_category, n, round(least(2 * v, 3) + 2 * r + (1 - least(n / 500.0::DOUBLE, 1)) + least(c / 20, 2), 4) AS score FROM s WHERE n >= 20""")
def view_scores(spark, d):
    return gaps.view_scores(papers(spark, d))


@query(f"""{P} SELECT primary_category, count(*) AS n, round(avg(CAST(is_survey AS DOUBLE)), 4) AS rate FROM papers WHERE primary_category IS NOT NULL GROUP BY 1 HAVING count(*) >= 20 AND round(avg(CAST(is_survey AS DOUBLE)), 4) < 0.3 ORDER BY rate, primary_category LIMIT 15""")
def low_rates(spark, d):
    return gaps.low_rates(papers(spark, d), F.col("is_survey"))


# --- authors ----------------------------------------------------------------------------------------------------------
@query(f"""{A}, t AS (SELECT author, year, CAST(sum(y) AS BIGINT) AS c FROM a GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY year DESC) AS i FROM t),
g AS (SELECT author, count(*) AS years, CAST(sum(c) AS BIGINT) AS citations, avg(c) AS o, avg(c) FILTER (WHERE i <= 3) AS r FROM x GROUP BY author)
SELECT author, years, citations, round(o, 4) AS overall, round(r, 4) AS recent, CASE WHEN r > 1.2 * o THEN 'accelerating' WHEN r < 0.8 * o THEN 'decelerating' ELSE 'steady' END AS trend FROM g""")
def author_citation_growth(spark, d):
    return authors.citation_growth(papers(spark, d))


@query(f"""{P}, r AS (SELECT arxiv_id, author_list AS l, unnest(author_list) AS author FROM papers), o AS (SELECT author, count(*) AS papers, count(*) FILTER (WHERE len(l) <= 1) AS solo, sum(CASE WHEN len(l) > 1 THEN len(l) ELSE 0 END) AS met FROM r GROUP BY author),
c AS (SELECT author, count(DISTINCT other) AS coauthors FROM (SELECT author, unnest(l) AS other FROM r WHERE len(l) > 1) GROUP BY author)
SELECT author, papers, solo, round(solo * 100.0::DOUBLE / papers, 1) AS solo_rate, coalesce(coauthors, 0) AS coauthors, round(CAST(met AS DOUBLE) / papers, 2) AS coauthors_per_paper FROM o LEFT JOIN c USING (author)""")
def collaboration_patterns(spark, d):
    return authors.collaboration_patterns(papers(spark, d))


@query(f"{A}, m AS (SELECT author, other, count(*) AS papers FROM co GROUP BY ALL) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY author ORDER BY papers DESC, other) <= 10")
def closest_coauthors(spark, d):
    return authors.closest(papers(spark, d))


@query(f"{A}, k AS (SELECT author, count(*) AS k FROM a GROUP BY author) SELECT count(*) AS authors, round(avg(k), 4) AS avg_papers, max(k) AS max_papers, count(*) FILTER (WHERE k > 1) AS with_several FROM k")
def author_index_summary(spark, d):
    return authors.index_summary(papers(spark, d))


@query(f"{A} SELECT author AS a, other AS b, count(*) AS papers FROM co WHERE author < other GROUP BY ALL ORDER BY papers DESC, a, b LIMIT 20")
def top_coauthor_pairs(spark, d):
    return authors.top_pairs(papers(spark, d))


# --- benchmarks -------------------------------------------------------------------------------------------------------
_RANKED = f"WITH {SOTA_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY task_name, dataset_name, metric_name ORDER BY metric_value DESC, evaluation_date, row_id) AS rank FROM sota WHERE metric_value IS NOT NULL)"


def _evaluations(spark, d):
    return benchmarks.ranked(sota(spark, d)).withColumnRenamed("method_name", "arxiv_id")


@query(f"{_RANKED} SELECT method_name AS arxiv_id, count(*) AS evaluations, count(DISTINCT task_name) AS tasks, count(DISTINCT dataset_name) AS datasets, count(*) FILTER (WHERE rank = 1) AS firsts, bool_or(rank = 1) AS is_sota FROM r WHERE method_name IS NOT NULL GROUP BY 1")
def benchmark_coverage(spark, d):
    return benchmarks.coverage(_evaluations(spark, d))


@query(f"{_RANKED} SELECT method_name AS arxiv_id, count(*) AS total, array_to_string(list_sort(list(DISTINCT task_name)), ',') AS tasks, true AS current FROM r WHERE method_name IS NOT NULL AND rank = 1 GROUP BY 1")
def sota_papers(spark, d):
    return benchmarks.sota_papers(_evaluations(spark, d)).withColumn("tasks", F.array_join("tasks", ","))


@query(f"WITH {SOTA_SQL} SELECT dataset_name, count(*) AS n FROM sota WHERE metric_value IS NOT NULL AND dataset_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, dataset_name LIMIT 20")
def leading_datasets(spark, d):
    return benchmarks.leading(_evaluations(spark, d), "dataset_name")


# --- citation graph ---------------------------------------------------------------------------------------------------
# A chain is one customer's orders: its components are the customers with two orders or more.
@query("WITH k AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS components, max(size) AS largest, CAST(sum(size) AS BIGINT) AS nodes FROM k")
def citation_components(spark, d):
    return graph.component_sizes(_chain(spark, d))


@query(f"""WITH {_CHAIN}, u AS (SELECT src AS id, 1 AS o, 0 AS i FROM cite UNION ALL SELECT dst, 0, 1 FROM cite), g AS (SELECT id, CAST(sum(o) AS BIGINT) AS o, CAST(sum(i) AS BIGINT) AS i FROM u GROUP BY id),
k AS (SELECT i, o, row_number() OVER (ORDER BY i, id) - 1 AS ri, row_number() OVER (ORDER BY o, id) - 1 AS ro, count(*) OVER () AS n FROM g)
SELECT min(i) AS min_in, max(i) AS max_in, round(avg(i), 4) AS avg_in, max(i) FILTER (WHERE ri = n // 2) AS median_in, min(o) AS min_out, max(o) AS max_out, round(avg(o), 4) AS avg_out, max(o) FILTER (WHERE ro = n // 2) AS median_out, true AS is_dag FROM k""")
def degree_spread(spark, d):
    return graph.degree_spread(_chain(spark, d))


# --- vectors and full text --------------------------------------------------------------------------------------------
@query("""WITH v AS (SELECT vec_id, label AS c, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.vec_id, a.c, b.c AS o, a.vec_id = b.vec_id AS own, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v a, v b),
m AS (SELECT vec_id, c, o, sum(d) AS s, count(*) AS n FROM p GROUP BY ALL), q AS (SELECT vec_id, c, max(CASE WHEN o = c THEN s / greatest(n - 1, 1) END) AS a, max(CASE WHEN o = c THEN n END) AS n, min(CASE WHEN o <> c THEN s / n END) AS b FROM m GROUP BY ALL)
SELECT c AS cluster, count(*) AS n, round(avg(CASE WHEN n = 1 OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 4) AS silhouette FROM q GROUP BY 1""")
def silhouette(spark, d):
    return vectors.silhouette(read(spark, d, "embeddings"))


@query(r"""WITH w AS (SELECT source, unnest(regexp_split_to_array(lower(string_split(text, chr(10))[1]), '\s+')) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w WHERE length(word) > 3 AND regexp_full_match(word, '\p{L}+') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS i FROM c) SELECT source, string_agg(word, ', ' ORDER BY i) AS words FROM r WHERE i <= 3 GROUP BY source""")
def cluster_labels(spark, d):
    rows = read(spark, d, "documents").select("source", F.element_at(F.split("text", "\n"), 1).alias("title"))
    return vectors.title_words(rows, "source", "title", 3, 3)


@query(f"{P}, u AS (SELECT DISTINCT arxiv_id, unnest(methods) AS theme FROM papers) SELECT theme, count(*) AS n FROM u GROUP BY 1")
def theme_counts(spark, d):
    return fulltext.theme_counts(papers(spark, d), "methods")


# --- titles, terms, whole lexicons, topics over the years -------------------------------------------------------------
_CITED = f"""{P}, x AS (SELECT coalesce(text, '') AS abstract, string_split(coalesce(text, ''), chr(10))[1] AS title, CAST(coalesce(citations, 0) AS DOUBLE) AS y FROM documents LEFT JOIN papers ON doc_id = arxiv_id)"""
_WORDS = "len(list_filter(string_split_regex({}, '[\\x09-\\x0D\\x20]+'), lambda w: w <> ''))"


def _cited(spark, d):
    """All documents, the first line as title, with the citations of the paper of the same number."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("arxiv_id"), F.coalesce("text", F.lit("")).alias("abstract"))
    return docs.withColumn("title", F.split("abstract", "\n")[0]).join(papers(spark, d).select("arxiv_id", "citations"), "arxiv_id", "left")


@query(f"""{_CITED}, t AS (SELECT y, unnest(['has_colon', 'has_question', 'short_title']) AS trait, unnest([contains(title, ':'), contains(title, '?'), {_WORDS.format("title")} <= 8]) AS f FROM x)
SELECT trait, count(*) FILTER (f) AS n_with, count(*) FILTER (NOT f) AS n_without, round(avg(y) FILTER (f), 4) AS avg_with, round(avg(y) FILTER (NOT f), 4) AS avg_without, round(avg(y) FILTER (f) / greatest(avg(y) FILTER (NOT f), 0.1), 2) AS lift
FROM t GROUP BY trait HAVING count(*) FILTER (f) > 0 AND count(*) FILTER (NOT f) > 0""")
def title_traits(spark, d):
    return impact.title_traits(_cited(spark, d))


@query(f"""{_CITED}, n AS (SELECT y, {_WORDS.format("abstract")} AS n FROM x) SELECT CASE WHEN n < 100 THEN 'short (<100 words)' WHEN n < 200 THEN 'medium (100-200)' WHEN n < 300 THEN 'long (200-300)' ELSE 'very long (300+)' END AS bucket,
count(*) AS n, round(avg(y), 4) AS avg_citations, median(y) AS median_citations FROM n GROUP BY 1""")
def abstract_words(spark, d):
    return impact.buckets(_cited(spark, d), impact.words("abstract"), impact.ABSTRACT_BUCKETS, "very long (300+)")


# Generated words have no synonyms; these stand for them: two variants of one term, and one whose canonical term is filtered.
_MERGES = {"orantion": "tion", "hehely": "tion", "thatin": "that"}
_UNWANTED = "(term IN ({}) OR regexp_matches(term, '^(?:.?.?.?$|tho)'))".format(", ".join(f"'{w}'" for w in L.SIMPLE_STOP_WORDS))


@query(_TOK + f""", c AS (SELECT source, term, count(*) AS n FROM k GROUP BY ALL), m AS (SELECT source, CASE term {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _MERGES.items())} ELSE term END AS term, n FROM c WHERE NOT {_UNWANTED})
SELECT source, term, CAST(sum(n) AS BIGINT) AS score FROM m WHERE NOT {_UNWANTED} GROUP BY ALL""")
def normalised_terms(spark, d):
    docs = _documents(spark, d)
    counted = text.tokens(docs, "abstract").join(docs.select(F.col("arxiv_id").alias("id"), "source"), "id").groupBy("source", "term").agg(F.count(F.lit(1)).alias("score"))
    return text.process_keywords(counted, L.SIMPLE_STOP_WORDS, [".?.?.?$", "tho"], _MERGES, ("source",))


def _found(spark, d, lexicon):
    docs = read(spark, d, "documents").select(text.hits(F.col("text"), lexicon).alias("found"))
    return fulltext.theme_counts(docs, "found", list(lexicon))


@query(_named_sql({k: [p] for k, p in L.METHODS.items()}, "theme"))
def methods_found(spark, d):
    return _found(spark, d, L.METHODS)


@query(_named_sql({k: [p] for k, p in L.DATASETS.items()}, "theme"))
def datasets_found(spark, d):
    return _found(spark, d, L.DATASETS)


@query(f"""{P}, t AS (SELECT au AS author, year, unnest(category_list) AS topic FROM (SELECT unnest(author_list) AS au, year, category_list FROM papers WHERE year IS NOT NULL)),
g AS (SELECT author, topic, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS active_years FROM t GROUP BY ALL) SELECT *, last_year >= {NOW} - 2 AS is_current FROM g WHERE active_years >= 2""")
def topic_migration(spark, d):
    return authors.migration(papers(spark, d), NOW)


@query(f"""{P} SELECT custkey, count(*) AS papers, round(avg(velocity), 4) AS avg_velocity FROM papers WHERE velocity > 0 AND custkey IS NOT NULL GROUP BY custkey HAVING count(*) < 50 AND avg(velocity) > 1""")
def hot_low_volume(spark, d):
    return gaps.hot_low_volume(papers(spark, d), "custkey")


@query(f"""WITH RECURSIVE {_CHAIN}, l(id) AS (SELECT max(src) FROM cite UNION SELECT dst FROM l JOIN cite ON src = id) SELECT id FROM l WHERE id IN (SELECT dst FROM cite) AND id NOT IN (SELECT src FROM cite)""")
def lineage_roots(spark, d):
    e = _chain(spark, d)
    return graph.lineage_roots(e, e.agg(F.max("src")).first()[0])
