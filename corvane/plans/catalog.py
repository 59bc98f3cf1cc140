"""The registered queries: every operator over the adapter tables, beside the SQL it must agree with.

The generated tables are uniform, so thresholds are set where results aren't empty; the operators keep their own defaults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import authors, benchmarks, fulltext, gaps, graph, impact, landscape, linkage, stats, text, trajectories, trends, vectors
from ..sources.adapters import HISTORY_SQL, PAPERS_SQL, SOTA_SQL, history, papers, read, sota

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
P, H, S = f"WITH {PAPERS_SQL}", f"WITH {HISTORY_SQL}", f"WITH {SOTA_SQL}"
NOW = 2001


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- trends -----------------------------------------------------------------------------------------------------------
def _trend_sql(source: str, entity: str, eps: float, up: float, down: float) -> str:
    return f"""{P}, s AS ({source}), x AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY month) - 1 AS x, count(*) OVER (PARTITION BY e) AS n FROM s),
g AS (SELECT e, CAST(sum(k) AS BIGINT) AS total, count(*) AS periods, round(coalesce(regr_slope(k, x), 0), 4) AS slope,
  round(CASE WHEN var_pop(k) = 0 THEN 0 ELSE greatest(coalesce(regr_r2(k, x), 0), 0) END, 4) AS r2,
  sum(CASE WHEN x < floor(n / 4) THEN k ELSE 0 END) AS f, sum(CASE WHEN x >= n - ceil(n / 4) THEN k ELSE 0 END) AS l FROM x GROUP BY e),
m AS (SELECT *, CASE WHEN periods >= 4 THEN round((l - f) / CAST(greatest(f, 1) AS DOUBLE), 2) ELSE 0 END AS momentum FROM g WHERE periods >= 2)
SELECT e AS {entity}, total, periods, slope, r2, CASE WHEN slope > {eps} AND r2 > 0 THEN 'increasing' WHEN slope < -{eps} AND r2 > 0 THEN 'decreasing' ELSE 'stable' END AS direction,
  momentum, CASE WHEN momentum > {up} AND slope > 0 THEN 'emerging' WHEN momentum < {down} AND slope < 0 THEN 'declining' ELSE 'stable' END AS status FROM m"""


_CAT = "SELECT primary_category AS e, month, count(*) AS k FROM papers WHERE primary_category IS NOT NULL GROUP BY ALL"
_METHOD = "SELECT m AS e, month, count(*) AS k FROM (SELECT unnest(methods) AS m, month FROM papers) GROUP BY ALL"
_LABEL = "SELECT c AS e, month, count(*) AS k FROM (SELECT unnest(category_list) AS c, month FROM papers) GROUP BY ALL"


@query(_trend_sql(_LABEL, "category", 0.005, 0.02, -0.02))
def category_trends(spark, d):
    return trends.trend(trends.series(papers(spark, d), "category", "category_list"), "category", eps=0.005, min_r2=0, up=0.02, down=-0.02)


@query(_trend_sql(_METHOD, "method", 0.005, 0.02, -0.02))
def method_trends(spark, d):
    return trends.trend(trends.series(papers(spark, d), "method", "methods"), "method", eps=0.005, min_r2=0, up=0.02, down=-0.02)


@query(f"""{P}, s AS ({_CAT}), x AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY month) - 1 AS x FROM s),
g AS (SELECT e, coalesce(regr_slope(k, x), 0) AS sl, CASE WHEN var_pop(k) = 0 THEN 0 ELSE greatest(coalesce(regr_r2(k, x), 0), 0) END AS r2, count(*) AS n, max_by(k, month) AS last FROM x GROUP BY e HAVING count(*) >= 6)
SELECT e AS primary_category, CAST(i AS INTEGER) AS step, CAST(greatest(0, round(last + round(sl, 4) * i)) AS BIGINT) AS predicted,
  CASE WHEN r2 < 0.3 THEN 'low' WHEN r2 < 0.7 THEN 'medium' ELSE 'high' END AS confidence FROM g, range(1, 4) t(i)""")
def category_forecast(spark, d):
    return trends.forecast(trends.series(papers(spark, d), "primary_category"), "primary_category")


@query(f"""{P}, s AS ({_LABEL}), x AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY month) - 1 AS x, count(*) OVER (PARTITION BY e) AS n FROM s),
g AS (SELECT e, CAST(sum(CASE WHEN x < n // 2 THEN k ELSE 0 END) AS BIGINT) AS early, CAST(sum(CASE WHEN x >= n // 2 THEN k ELSE 0 END) AS BIGINT) AS late FROM x GROUP BY e)
SELECT e AS category, early, late, round((late - early) / CAST(early AS DOUBLE) * 100, 1) AS growth_pct FROM g WHERE early > 0""")
def topic_growth(spark, d):
    return trends.growth(trends.series(papers(spark, d), "category", "category_list"), "category")


@query(f"""{P} SELECT primary_category, count(*) AS n, round(avg(velocity), 3) AS avg_velocity, round(max(velocity), 3) AS max_velocity, count(*) FILTER (WHERE velocity > 1) AS n_high
FROM papers WHERE velocity > 0 AND primary_category IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""")
def citation_velocity_by_category(spark, d):
    return trends.velocity_by(papers(spark, d))


@query(f"""{P}, r AS (SELECT primary_category AS e, month, coalesce(citations, 0) AS y, row_number() OVER (PARTITION BY primary_category ORDER BY coalesce(citations, 0)) AS i FROM papers WHERE primary_category IS NOT NULL),
a AS (SELECT e, count(*) AS total, avg(y) AS avg_c, greatest(0, least(1, 2 * CAST(sum(i * y) AS DOUBLE) / (count(*) * CAST(sum(y) AS DOUBLE)) - (count(*) + 1) / CAST(count(*) AS DOUBLE))) AS gini FROM r GROUP BY e),
s AS ({_CAT}), x AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY month) - 1 AS x FROM s), f AS (SELECT e, round(coalesce(regr_slope(k, x), 0), 4) AS slope FROM x GROUP BY e HAVING count(*) >= 3),
o AS (SELECT *, total / 100.0 * 0.3 + (1 - avg_c / 100) * 0.3 + gini * 0.2 + greatest(-slope, 0) * 0.2 AS score FROM a JOIN f USING (e))
SELECT e AS primary_category, total, round(avg_c, 4) AS avg_citations, round(gini, 4) AS gini, slope, round(CAST(score AS DOUBLE), 4) AS score, CASE WHEN score > 0.6 THEN 'saturated' WHEN score > 0.4 THEN 'competitive' ELSE 'opportunity' END AS label FROM o""")
def saturation_gini(spark, d):
    return trends.saturation(papers(spark, d))


@query(f"""{P} SELECT arxiv_id, primary_category, citations, round(velocity, 4) AS velocity FROM papers WHERE velocity > 0.5 OR (velocity > 0.2 AND paper_age_days < 180) ORDER BY round(velocity, 4) DESC, arxiv_id LIMIT 50""")
def hot_papers(spark, d):
    return trends.hot(papers(spark, d))


@query(f"""{P} SELECT arxiv_id, citations, paper_age_days, round(velocity, 4) AS velocity FROM papers WHERE paper_age_days > 730 AND velocity > 0.3 AND citations < 50 ORDER BY round(velocity, 4) DESC, arxiv_id LIMIT 30""")
def sleeping_beauties_snapshot(spark, d):
    return trends.sleeping(papers(spark, d))


@query(f"""{P}, c AS (SELECT year || '-Q' || quarter(published_date) AS quarter, primary_category, count(*) AS n FROM papers WHERE primary_category IS NOT NULL GROUP BY ALL)
SELECT quarter, primary_category, n FROM c QUALIFY row_number() OVER (PARTITION BY quarter ORDER BY n DESC, primary_category) <= 5""")
def quarterly_trends(spark, d):
    return trends.quarterly(papers(spark, d))


@query(f"""{P} SELECT month, {', '.join(f"count(*) FILTER (WHERE primary_category = 'Brand#{i}') AS b{i}" for i in (11, 12, 13))} FROM papers WHERE primary_category IS NOT NULL GROUP BY month""")
def month_category_pivot(spark, d):
    out = trends.month_matrix(papers(spark, d), values=["Brand#11", "Brand#12", "Brand#13"])
    return out.toDF("month", "b11", "b12", "b13")


# --- gaps -------------------------------------------------------------------------------------------------------------
@query(f"""{P}, p AS (SELECT arxiv_id, unnest(category_list) AS c FROM papers), z AS (SELECT c, count(*) AS size FROM p GROUP BY c), t AS (SELECT count(*) AS total FROM papers),
q AS (SELECT a.c AS cat1, b.c AS cat2, count(*) AS actual FROM p a JOIN p b ON a.arxiv_id = b.arxiv_id AND a.c < b.c GROUP BY ALL),
e AS (SELECT q.*, x.size * y.size / CAST(total AS DOUBLE) AS e FROM q JOIN z x ON x.c = cat1 JOIN z y ON y.c = cat2, t WHERE x.size > 20 AND y.size > 20)
SELECT cat1, cat2, actual, round(e, 1) AS expected, round(actual / e, 3) AS ratio, round((1 - actual / e) * least(e, 50), 1) AS score FROM e WHERE e > 5 AND actual / e < 0.95
ORDER BY score DESC, cat1, cat2 LIMIT 30""")
def category_pairs(spark, d):
    return gaps.pair_gaps(papers(spark, d), max_ratio=0.95)


@query(f"""{P}, p AS (SELECT DISTINCT arxiv_id, left(unnest(category_list), 7) AS c FROM papers), z AS (SELECT c, count(*) AS size FROM p GROUP BY c), t AS (SELECT count(*) AS total FROM papers),
q AS (SELECT a.c AS cat1, b.c AS cat2, count(*) AS actual FROM p a JOIN p b ON a.arxiv_id = b.arxiv_id AND a.c < b.c GROUP BY ALL),
e AS (SELECT q.*, x.size * y.size / CAST(total AS DOUBLE) AS e FROM q JOIN z x ON x.c = cat1 JOIN z y ON y.c = cat2, t WHERE x.size > 20 AND y.size > 20)
SELECT cat1, cat2, actual, round(e, 1) AS expected, round(actual / e, 3) AS ratio, round((1 - actual / e) * least(e, 50), 1) AS score FROM e WHERE e > 10 AND actual / e < 1.2
ORDER BY score DESC, cat1, cat2 LIMIT 30""")
def cross_discipline(spark, d):
    p = papers(spark, d).withColumn("prefixes", F.array_distinct(F.transform("category_list", lambda x: F.substring(x, 1, 7))))
    return gaps.pair_gaps(p, "prefixes", min_expected=10, max_ratio=1.2)


_DOMAIN = """{p}, u AS (SELECT unnest({items}) AS item, {key} AS cat FROM papers WHERE {key} IS NOT NULL), a AS (SELECT item, cat, count(*) AS actual FROM u GROUP BY ALL),
i AS (SELECT item, count(*) AS it FROM u GROUP BY item HAVING count(*) >= 20), c AS (SELECT {key} AS cat, count(*) AS ct FROM papers WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) >= 30),
e AS (SELECT i.item, c.cat, coalesce(actual, 0) AS actual, ct * it / CAST((SELECT count(*) FROM papers) AS DOUBLE) AS e FROM i CROSS JOIN c LEFT JOIN a ON a.item = i.item AND a.cat = c.cat)
SELECT item, cat, actual, round(e, 1) AS expected, round(e - actual, 1) AS gap FROM e WHERE e > 3 AND actual < {factor} * e ORDER BY gap DESC, item, cat LIMIT 50"""


@query(_DOMAIN.format(p=P, items="methods", key="primary_category", factor=0.98))
def method_domain_gaps(spark, d):
    return gaps.domain_gaps(papers(spark, d), factor=0.98)


@query(_DOMAIN.format(p=P, items="category_list", key="venue", factor=0.98))
def dataset_gaps(spark, d):
    return gaps.domain_gaps(papers(spark, d), items="category_list", key="venue", factor=0.98)


@query(f"{P} SELECT arxiv_id, primary_category, citations FROM papers WHERE coalesce(citations, 0) >= 20 AND NOT has_code ORDER BY citations DESC, arxiv_id LIMIT 50")
def repro_gaps(spark, d):
    return gaps.reproducibility(papers(spark, d))


@query(f"{P} SELECT primary_category, count(*) AS n, round(avg(CAST(has_code AS DOUBLE)), 4) AS code_rate FROM papers WHERE primary_category IS NOT NULL GROUP BY 1 HAVING count(*) >= 20")
def code_rates(spark, d):
    return gaps.code_rate(papers(spark, d))


_SHARES = f"""{P}, s AS (SELECT primary_category, count(*) AS n, count(*) FILTER (WHERE is_survey) AS surveys, avg(CAST(is_survey AS DOUBLE)) AS sr,
 avg(CASE WHEN (CASE WHEN coalesce(paper_age_days, 0) = 0 THEN 365 ELSE paper_age_days END) < 180 THEN 1.0 ELSE 0.0 END) AS rec, avg(CAST(has_code AS DOUBLE)) AS code, avg(coalesce(velocity, 0)) AS v, avg(coalesce(citations, 0)) AS c
 FROM papers WHERE primary_category IS NOT NULL GROUP BY 1)"""


@query(f"{_SHARES} SELECT primary_category, n, surveys, round(sr, 4) AS survey_ratio, round(n * 0.01 + (1 - sr) * 5 + rec * 3, 4) AS score FROM s WHERE n >= 50 AND (surveys < 3 OR sr < 0.25)")
def survey_opportunities(spark, d):
    return gaps.survey_opportunities(papers(spark, d), max_ratio=0.25)


@query(f"""{P}, u AS (SELECT unnest(methods) AS item, has_code AS a FROM papers) SELECT item, count(*) AS n, round(avg(CAST(a AS DOUBLE)), 4) AS applied_rate FROM u GROUP BY item HAVING count(*) >= 20 AND round(avg(CAST(a AS DOUBLE)), 4) < 0.5""")
def application_gaps(spark, d):
    return gaps.application_gaps(papers(spark, d), F.col("has_code"), max_rate=0.5)


@query(f"""{_SHARES} SELECT primary_category, n, round(least(2 * v, 3) + 2 * rec + 2 * (1 - sr) + (1 - least(n / 500.0, 1)) + least(c / 20, 2), 4) AS score,
 CASE WHEN v > 1 AND sr < 0.02 THEN 'Hot topic needs survey' WHEN v > 0.5 AND code < 0.2 THEN 'Growing area needs implementations' WHEN rec > 0.5 THEN 'Rapidly emerging field' WHEN n < 100 AND v > 0.3 THEN 'Niche with high impact potential' ELSE 'Established area' END AS recommendation
 FROM s WHERE n >= 20""")
def opportunity_scores(spark, d):
    return gaps.opportunity_scores(papers(spark, d))


@query(f"""{P} SELECT venue, count(*) AS n FROM papers p WHERE NOT EXISTS (SELECT 1 FROM papers q WHERE q.is_survey AND q.venue = p.venue) GROUP BY 1 HAVING count(*) > 100""")
def needs_survey_anti(spark, d):
    return gaps.without_survey(papers(spark, d), "venue")


# --- impact -----------------------------------------------------------------------------------------------------------
@query(f"""{P}, l AS (SELECT coalesce(citations, 0) AS y, unnest([{{'f': 'has_code', 'o': has_code}}, {{'f': 'is_survey', 'o': is_survey}}]) AS s FROM papers),
g AS (SELECT s.f AS feature, count(*) FILTER (WHERE s.o) AS n_with, count(*) FILTER (WHERE NOT s.o) AS n_without, round(avg(y) FILTER (WHERE s.o) / greatest(avg(y) FILTER (WHERE NOT s.o), 0.1), 2) AS lift FROM l GROUP BY 1)
SELECT *, CASE WHEN lift > 1.2 THEN 'positive' WHEN lift < 0.8 THEN 'negative' ELSE 'neutral' END AS impact FROM g WHERE n_with > 0 AND n_without > 0""")
def binary_lifts(spark, d):
    return impact.binary_lifts(papers(spark, d), ["has_code", "is_survey"])


@query(f"""{P}, r AS (SELECT paper_age_days AS f, CAST(coalesce(citations, 0) AS DOUBLE) AS y, row_number() OVER (ORDER BY paper_age_days, arxiv_id) - 1 AS rk, count(*) OVER () AS n FROM papers WHERE paper_age_days <> 0)
SELECT 'paper_age_days' AS feature, count(*) AS n, round(avg(y) FILTER (WHERE rk < n // 4), 4) AS q1_avg, round(avg(y) FILTER (WHERE rk >= n * 3 // 4), 4) AS q4_avg,
 CASE WHEN count(*) < 10 THEN 'insufficient' WHEN corr(f, y) > 0.3 THEN 'positive' WHEN corr(f, y) < -0.3 THEN 'negative' ELSE 'none' END AS correlation FROM r HAVING count(*) >= 20""")
def numeric_quartiles(spark, d):
    return impact.quartiles(papers(spark, d), "paper_age_days")


_SUCCESS = """{p}, r AS (SELECT {key} AS key, CAST(coalesce(citations, 0) AS DOUBLE) AS y, row_number() OVER (PARTITION BY {key} ORDER BY coalesce(citations, 0)) - 1 AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM papers WHERE {key} IS NOT NULL)
SELECT key, count(*) AS n, round(avg(y), 4) AS avg_citations, max(y) AS max_citations, max(y) FILTER (WHERE rn = n // 2) AS median_citations, max(y) FILTER (WHERE rn = n - 1 - n // 10) AS top10_threshold FROM r GROUP BY key HAVING count(*) >= {least}"""


@query(_SUCCESS.format(p=P, key="primary_category", least=10))
def category_success(spark, d):
    return impact.group_success(papers(spark, d), "primary_category")


@query(_SUCCESS.format(p=P, key="venue", least=5))
def venue_success(spark, d):
    return impact.group_success(papers(spark, d), "venue", 5)


@query(f"""{P}, u AS (SELECT unnest(methods) AS item, CAST(coalesce(citations, 0) AS DOUBLE) AS y FROM papers) SELECT item, count(*) AS n, round(avg(y), 4) AS avg_citations, max(y) AS max_citations FROM u GROUP BY item HAVING count(*) >= 10""")
def method_success(spark, d):
    return impact.item_success(papers(spark, d))


@query(f"""{P} SELECT CASE WHEN t <= 1 THEN 'solo' WHEN t <= 3 THEN '2-3' WHEN t <= 6 THEN '4-6' ELSE '7+' END AS bucket, count(*) AS n, round(avg(y), 4) AS avg_citations, median(y) AS median_citations
FROM (SELECT coalesce(len(author_list), 1) AS t, CAST(coalesce(citations, 0) AS DOUBLE) AS y FROM papers) GROUP BY 1""")
def team_size(spark, d):
    return impact.buckets(papers(spark, d), F.coalesce(F.when(F.col("author_list").isNotNull(), F.size("author_list")), F.lit(1)), impact.TEAM_BUCKETS, "7+")


@query(f"""{P} SELECT CASE WHEN price <= 50000 THEN 'small' WHEN price <= 150000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n, round(avg(y), 4) AS avg_citations, median(y) AS median_citations
FROM (SELECT price, CAST(coalesce(citations, 0) AS DOUBLE) AS y FROM papers) GROUP BY 1""")
def abstract_length(spark, d):
    return impact.buckets(papers(spark, d), F.col("price"), [(50000, "small"), (150000, "medium")], "large")


def _factors():
    return {"has_code": F.col("has_code"), "is_survey": F.col("is_survey"), "many": F.size("author_list") > 3}


_FORMULA = f"""{P}, z AS (SELECT arxiv_id, CAST(coalesce(citations, 0) AS DOUBLE) AS y, has_code AS a, is_survey AS b, coalesce(len(author_list) > 3, false) AS c FROM papers),
o AS (SELECT round(avg(y) FILTER (WHERE a) / greatest(avg(y) FILTER (WHERE NOT a), 0.1), 2) AS has_code, round(avg(y) FILTER (WHERE b) / greatest(avg(y) FILTER (WHERE NOT b), 0.1), 2) AS is_survey, round(avg(y) FILTER (WHERE c) / greatest(avg(y) FILTER (WHERE NOT c), 0.1), 2) AS many FROM z)"""


@query(f"""{_FORMULA}, l AS (SELECT unnest(['has_code', 'is_survey', 'many']) AS factor, unnest([has_code, is_survey, many]) AS multiplier FROM o)
SELECT factor, multiplier, CASE WHEN multiplier > 2 THEN 'strong' WHEN multiplier > 1.2 THEN 'moderate' WHEN multiplier > 0.8 THEN 'neutral' ELSE 'negative' END AS strength FROM l""")
def success_formula(spark, d):
    return impact.ranked_formula(impact.formula(papers(spark, d), _factors()))


@query(f"""{_FORMULA} SELECT arxiv_id, round((CASE WHEN a THEN has_code ELSE 1 END) * (CASE WHEN b THEN is_survey ELSE 1 END) * (CASE WHEN c THEN many ELSE 1 END), 4) AS score FROM z, o""")
def score_papers(spark, d):
    p = papers(spark, d)
    return impact.score(p, impact.formula(p, _factors()), _factors())


# --- statistics -------------------------------------------------------------------------------------------------------
@query(f"""{P} SELECT count(*) AS papers, CAST(sum(coalesce(citations, 0)) AS BIGINT) AS citations, round(avg(coalesce(citations, 0)), 4) AS avg_citations, max(citations) AS max_citations, min(month) AS first_month, max(month) AS last_month,
 round(avg(CASE WHEN has_code THEN 100.0 ELSE 0.0 END), 4) AS code_pct, round(avg(CASE WHEN is_survey THEN 100.0 ELSE 0.0 END), 4) AS survey_pct, count(DISTINCT primary_category) AS categories FROM papers""")
def summary_stats(spark, d):
    return stats.summary(papers(spark, d))


@query(f"""{P} SELECT primary_category, venue, CASE WHEN grouping(primary_category) + grouping(venue) = 2 THEN 'all' WHEN grouping(primary_category) = 0 THEN 'primary_category' ELSE 'venue' END AS level,
 count(*) AS n, CAST(sum(coalesce(citations, 0)) AS BIGINT) AS citations FROM papers GROUP BY GROUPING SETS ((primary_category), (venue), ())""")
def dataset_statistics_gsets(spark, d):
    return stats.grouping_statistics(papers(spark, d))


@query(f"""{P} SELECT arxiv_id, row_number() OVER (ORDER BY velocity DESC, arxiv_id) AS rank, round(100 * (1 - row_number() OVER (ORDER BY velocity DESC, arxiv_id) / CAST(count(*) OVER () AS DOUBLE)), 4) AS percentile FROM papers WHERE velocity IS NOT NULL""")
def velocity_rank(spark, d):
    return stats.velocity_rank(papers(spark, d))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) = 1")
def dedupe_first(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return stats.dedupe(rows, "l_orderkey", F.asc("l_linenumber"), F.asc("l_suppkey"), F.asc("l_partkey"))


@query(f"{P} SELECT arxiv_id, CAST(has_code AS INTEGER) + CAST(is_survey AS INTEGER) + CAST(coalesce(citations > 100, false) AS INTEGER) AS quality_signals FROM papers")
def quality_signals(spark, d):
    return stats.quality_signals(papers(spark, d), [F.col("has_code"), F.col("is_survey"), F.col("citations") > 100])


@query(f"""{P} SELECT arxiv_id, month, citations FROM papers WHERE primary_category = 'Brand#11' AND published_date >= DATE '1996-01-01' AND coalesce(citations, 0) >= 10 ORDER BY citations DESC NULLS LAST, arxiv_id LIMIT 20 OFFSET 20""")
def explorer_page(spark, d):
    return stats.explorer(papers(spark, d), "Brand#11", "1996-01-01", least=10, page=1).select("arxiv_id", "month", "citations")


@query(f"""{P} (SELECT 'cited' AS list, arxiv_id, CAST(citations AS DOUBLE) AS key FROM papers WHERE citations IS NOT NULL ORDER BY key DESC, arxiv_id LIMIT 100)
UNION ALL (SELECT 'code', arxiv_id, CAST(citations AS DOUBLE) AS key FROM papers WHERE has_code AND citations IS NOT NULL ORDER BY key DESC, arxiv_id LIMIT 100)""")
def top_lists(spark, d):
    there = F.col("citations").isNotNull()
    return stats.top_lists(papers(spark, d), {"cited": (there, F.col("citations")), "code": (F.col("has_code") & there, F.col("citations"))})


@query(f"""{P} SELECT primary_category, count(*) AS n, round(avg(coalesce(citations, 0)), 4) AS avg_citations, round(avg(CAST(has_code AS DOUBLE)), 4) AS code_rate FROM papers WHERE primary_category IN ('Brand#11', 'Brand#12') GROUP BY 1""")
def compare_categories(spark, d):
    return stats.compare_categories(papers(spark, d), "Brand#11", "Brand#12")


@query(f"{P} SELECT least(CAST(floor(citations / 10.0) AS BIGINT), 49) AS bin, count(*) AS n FROM papers WHERE citations IS NOT NULL GROUP BY 1")
def citation_histogram(spark, d):
    return stats.histogram(papers(spark, d), "citations", 10.0, 50)


# --- authors ----------------------------------------------------------------------------------------------------------
A = f"""{P}, a AS (SELECT unnest(author_list) AS author, generate_subscripts(author_list, 1) - 1 AS position, arxiv_id, year, primary_category, category_list, coalesce(citations, 0) AS y, coalesce(velocity, 0) AS v FROM papers),
co AS (SELECT x.author, y.author AS other, x.arxiv_id, x.year FROM a x JOIN a y ON x.arxiv_id = y.arxiv_id AND x.author <> y.author)"""
_OWN = "SELECT author, count(*) AS papers, count(*) FILTER (WHERE position = 0) AS first_author, CAST(sum(y) AS BIGINT) AS citations, count(DISTINCT primary_category) AS categories FROM a GROUP BY author"
_CO = "SELECT author, count(DISTINCT other) AS collaborators FROM co GROUP BY author"


@query(f"{A} SELECT o.*, coalesce(collaborators, 0) AS collaborators FROM ({_OWN}) o LEFT JOIN ({_CO}) USING (author)")
def author_rollup(spark, d):
    return authors.rollup(papers(spark, d))


@query(f"""{A}, m AS (SELECT author, primary_category FROM (SELECT author, primary_category, count(*) AS k FROM a WHERE primary_category IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY author ORDER BY k DESC, primary_category) = 1)
SELECT author, papers, main_category, round(f * 100.0 / papers, 1) AS first_author_rate, y1 - y0 + 1 AS span, round(papers / CAST(y1 - y0 + 1 AS DOUBLE), 4) AS papers_per_year
FROM (SELECT author, count(*) AS papers, count(*) FILTER (WHERE position = 0) AS f, min(year) AS y0, max(year) AS y1 FROM a GROUP BY author HAVING count(*) >= 3) JOIN (SELECT author, primary_category AS main_category FROM m) USING (author)""")
def prolific_authors(spark, d):
    return authors.prolific(papers(spark, d))


@query(f"""{A} SELECT author, papers, citations, coalesce(collaborators, 0) AS collaborators, round(2 * ln(1 + citations) + 1.5 * ln(1 + papers) + 0.5 * ln(1 + coalesce(collaborators, 0)), 4) AS score
FROM ({_OWN}) LEFT JOIN ({_CO}) USING (author) ORDER BY score DESC, author LIMIT 50""")
def influential_authors(spark, d):
    return authors.influential(papers(spark, d))


@query(f"""{A}, h AS (SELECT author, count(*) FILTER (WHERE y >= rn) AS h_index FROM (SELECT author, y, row_number() OVER (PARTITION BY author ORDER BY y DESC) AS rn FROM a) GROUP BY author),
o AS (SELECT author, count(*) AS papers, CAST(sum(y) AS BIGINT) AS citations, avg(v) AS v FROM a GROUP BY author HAVING count(*) >= 2)
SELECT author, papers, citations, h_index, round(2 * ln(1 + citations) + 3 * h_index + 10 * v + 0.5 * ln(1 + coalesce(collaborators, 0)), 4) AS score, round(citations / CAST(greatest(coalesce(collaborators, 0), 1) AS DOUBLE), 4) AS citations_per_coauthor
FROM o JOIN h USING (author) LEFT JOIN ({_CO}) USING (author) ORDER BY score DESC, author LIMIT 50""")
def author_hindex(spark, d):
    return authors.influential_h(papers(spark, d))


@query(f"""{A}, o AS (SELECT author, count(*) AS papers, {NOW} - min(year) + 1 AS career, CAST(sum(y) AS BIGINT) AS citations, avg(y) AS av, count(*) FILTER (WHERE year >= {NOW - 2}) AS rc, avg(y) FILTER (WHERE year >= {NOW - 2}) AS ra, coalesce(sum(v) FILTER (WHERE year >= {NOW - 2}), 0) AS v FROM a GROUP BY author)
SELECT author, papers, CAST(career AS INTEGER) AS career, citations, round(2 * least(v / 5, 2) + 1.5 * (ra / greatest(av, 1)) + (1 + 0.1 * (8 - career)) + 0.5 * ln(1 + citations), 4) AS score FROM o WHERE papers BETWEEN 3 AND 1000000 AND career <= 8 AND rc >= 1 ORDER BY score DESC, author LIMIT 50""")
def rising_stars(spark, d):
    return authors.rising(papers(spark, d), NOW, most=1_000_000)


@query(f"""{P}, hit AS (SELECT *, CAST(venue LIKE '%URGENT%' AS INTEGER) AS u, CAST(primary_category LIKE '%1' AS INTEGER) AS b FROM papers), r AS (SELECT unnest(author_list) AS author, coalesce(citations, 0) AS y, coalesce(u, 0) AS u, coalesce(b, 0) AS b FROM hit WHERE coalesce(u, 0) + coalesce(b, 0) > 0),
o AS (SELECT author, count(*) AS papers, CAST(sum(y) AS BIGINT) AS citations, (max(u) + max(b)) / 2.0 AS coverage, avg((u + b) / 2.0) AS rel FROM r WHERE author NOT IN (1, 2) GROUP BY author)
SELECT author, papers, citations, round(CAST(coverage AS DOUBLE), 4) AS coverage, round(3 * coverage + 2 * rel + 0.5 * ln(1 + citations) + 0.5 * ln(1 + papers), 4) AS score FROM o ORDER BY score DESC, author LIMIT 50""")
def collaborator_match(spark, d):
    return authors.collaborators(papers(spark, d), {"urgent": F.col("venue").contains("URGENT"), "one": F.col("primary_category").endswith("1")}, [1, 2])


@query(f"{A} SELECT author, year, count(*) AS papers, CAST(sum(y) AS BIGINT) AS citations FROM a GROUP BY ALL")
def author_timeline(spark, d):
    return authors.timeline(papers(spark, d))


_TL = f"{A}, t AS (SELECT author, year, count(*) AS papers, CAST(sum(y) AS BIGINT) AS citations FROM a GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY year) - 1 AS x, count(*) OVER (PARTITION BY author) AS n FROM t)"


@query(f"""{_TL}, g AS (SELECT author, round(coalesce(regr_slope(papers, x), 0), 4) AS slope, count(*) AS active_years FROM x GROUP BY author), p AS (SELECT author, year AS peak_year FROM t QUALIFY row_number() OVER (PARTITION BY author ORDER BY papers DESC, year) = 1)
SELECT author, slope, active_years, peak_year, CASE WHEN active_years < 2 THEN 'insufficient_data' WHEN slope > 0.5 THEN 'increasing' WHEN slope < -0.5 THEN 'decreasing' ELSE 'stable' END AS trend FROM g JOIN p USING (author)""")
def author_trends(spark, d):
    return authors.timeline_trend(papers(spark, d))


@query(f"""{_TL}, g AS (SELECT author, count(*) AS years, avg(papers) FILTER (WHERE x < n // 2) AS p0, avg(papers) FILTER (WHERE x >= n // 2) AS p1, avg(citations) FILTER (WHERE x < n // 2) AS c0, avg(citations) FILTER (WHERE x >= n // 2) AS c1 FROM x GROUP BY author HAVING count(*) >= 3),
m AS (SELECT author, years, 0.4 * ((p1 - p0) / greatest(p0, 1)) + 0.6 * ((c1 - c0) / greatest(c0, 1)) AS m FROM g)
SELECT author, years, round(m, 4) AS momentum, CASE WHEN m > 0.3 THEN 'accelerating' WHEN m < -0.3 THEN 'decelerating' ELSE 'steady' END AS label FROM m""")
def author_momentum(spark, d):
    return authors.momentum(papers(spark, d))


@query(f"""{P}, r AS (SELECT unnest(author_list) AS author, year, category_list FROM papers), y AS (SELECT *, dense_rank() OVER (PARTITION BY author ORDER BY year) - 1 AS yr FROM r), n AS (SELECT author, max(yr) + 1 AS n FROM y GROUP BY author),
t AS (SELECT author, yr, n, unnest(category_list) AS topic FROM y JOIN n USING (author) WHERE n >= 3),
g AS (SELECT author, topic, count(*) FILTER (WHERE yr < n // 3) AS early, count(*) FILTER (WHERE yr >= n - CAST(ceil(n / 3.0) AS BIGINT)) AS late FROM t GROUP BY ALL),
c AS (SELECT *, CASE WHEN late > 2 * early AND late >= 2 THEN 'emerged' WHEN early > 2 * late AND early >= 2 THEN 'faded' END AS change FROM g) SELECT * FROM c WHERE change IS NOT NULL""")
def topic_evolution(spark, d):
    return authors.topics(papers(spark, d))


@query(f"""{A}, h AS (SELECT author, count(*) FILTER (WHERE y >= rn) AS h_index FROM (SELECT author, y, row_number() OVER (PARTITION BY author ORDER BY y DESC) AS rn FROM a) GROUP BY author), l AS (SELECT author, CAST({NOW} - min(year) + 1 AS INTEGER) AS length FROM a GROUP BY author)
SELECT author, length, h_index, CASE WHEN length <= 5 THEN 'early_career' WHEN length <= 12 THEN 'mid_career' WHEN length <= 20 THEN 'senior' ELSE 'established' END AS stage, CASE WHEN h_index >= 50 THEN 'high' WHEN h_index >= 20 THEN 'significant' WHEN h_index >= 10 THEN 'moderate' ELSE 'emerging' END AS impact FROM l JOIN h USING (author)""")
def career_stage(spark, d):
    return authors.careers(papers(spark, d), NOW)


@query(f"""{A}, f AS (SELECT author, other, min(year) AS year FROM co GROUP BY ALL), p AS (SELECT author, year, count(*) AS truly_new FROM f GROUP BY ALL)
SELECT author, year, truly_new, CAST(sum(truly_new) OVER (PARTITION BY author ORDER BY year) AS BIGINT) AS cumulative FROM p""")
def cumulative_coauthors(spark, d):
    return authors.cumulative_coauthors(papers(spark, d))


# --- text -------------------------------------------------------------------------------------------------------------
def _documents(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("arxiv_id"), "source", F.lower("text").alias("abstract"))


# Words have letters, digits and _ of every script around them as borders. DuckDB's word border knows ASCII only, so the SQL
# first blanks other characters, then whole every word with a digit, _ or a letter outside a to z.
_E = r"""WITH d AS (SELECT doc_id AS id, source, regexp_replace(lower(coalesce(text, '')), '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g') AS t FROM documents),
e AS (SELECT id, source, regexp_replace(t, '[a-z]*[0-9_\x{80}-\x{10FFFF}][a-z0-9_\x{80}-\x{10FFFF}]*', ' ', 'g') AS t FROM d)"""
_TOK = _E + r", w AS (SELECT id, source, unnest(regexp_extract_all(t, '[a-z][a-z\-]+[a-z]')) AS term FROM e), k AS (SELECT * FROM w WHERE length(term) >= 3)"
LEX = {"the": r"\bthe\b", "hand": r"\bhand\b", "their": r"\b(?:than|that)\b", "cora": r"\bcora\b", "coco": r"\b(?:ms-?)?coco\b"}


@query(_E + r", w AS (SELECT unnest(regexp_extract_all(t, '[a-z]{4,}')) AS term FROM e), c AS (SELECT term, count(*) AS n FROM w GROUP BY term ORDER BY n DESC, term LIMIT 200) SELECT term, n FROM c WHERE term NOT IN ('that', 'this', 'with', 'from', 'have', 'been', 'which', 'their', 'more', 'will', 'also', 'such', 'than', 'into', 'these', 'other', 'some', 'only', 'based', 'using', 'paper', 'method', 'approach', 'results', 'propose', 'proposed', 'show', 'shown', 'model', 'models') ORDER BY n DESC, term LIMIT 50")
def keyword_counts(spark, d):
    return text.keyword_counts(_documents(spark, d), "abstract")


@query(_E + ", h AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name FROM e WHERE regexp_matches(t, '{p}')" for k, p in LEX.items()) + ") SELECT name, count(*) AS n FROM h GROUP BY name")
def lexicon_hits(spark, d):
    return text.frequency(_documents(spark, d).select(text.hits(F.col("abstract"), LEX).alias("hits")), "hits")


@query(_E + " SELECT id AS arxiv_id, least((" + " + ".join(f"CAST(regexp_matches(t, '{p}') AS INTEGER)" for p in LEX.values()) + ") / 5.0::DOUBLE, 1.0) AS novelty FROM e")
def novelty_score(spark, d):
    return _documents(spark, d).select("arxiv_id", text.novelty(F.col("abstract"), list(LEX.values())).alias("novelty"))


@query(_TOK + """, tf AS (SELECT id, term, count(*) AS tf FROM k GROUP BY ALL), m AS (SELECT id, max(tf) AS most FROM tf GROUP BY id), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT id) AS total FROM tf),
s AS (SELECT id, term, round(tf / CAST(most AS DOUBLE) * ln(total / CAST(1 + df AS DOUBLE)), 6) AS score FROM tf JOIN m USING (id) JOIN df USING (term), n) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, term) <= 5""")
def tfidf_topn(spark, d):
    return text.tfidf(text.document_counts(_documents(spark, d), "abstract"), n=5)


@query(_TOK + """, s AS (SELECT DISTINCT id, term FROM k), v AS (SELECT term, count(*) AS n FROM s GROUP BY term ORDER BY n DESC, term LIMIT 40), h AS (SELECT id, term FROM s SEMI JOIN v USING (term))
SELECT x.term AS a, y.term AS b, count(*) AS n FROM h x JOIN h y ON x.id = y.id AND x.term < y.term GROUP BY ALL HAVING count(*) >= 3""")
def cooccurrence(spark, d):
    return text.cooccurrence(text.tokens(_documents(spark, d), "abstract"), words=40)


@query()
def corpus_topics(spark, d):
    return text.topics(text.tokens(_documents(spark, d), "abstract"))


@query(_TOK + """, p AS (SELECT DISTINCT id, term, source AS period FROM k), o AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT period FROM p)),
x AS (SELECT id, term, i >= m // 2 AS late FROM p JOIN o USING (period)), z AS (SELECT greatest(count(DISTINCT id) FILTER (WHERE NOT late), 1) AS ed, greatest(count(DISTINCT id) FILTER (WHERE late), 1) AS ld FROM x),
c AS (SELECT term, count(*) FILTER (WHERE NOT late) AS early, count(*) FILTER (WHERE late) AS l FROM x GROUP BY term HAVING count(*) FILTER (WHERE late) >= 5),
g AS (SELECT *, (l / CAST(ld AS DOUBLE)) / nullif(early / CAST(ed AS DOUBLE), 0) AS g FROM c, z)
SELECT term, early, l AS late, round(g, 4) AS growth, g IS NULL AS is_new, round(l * coalesce(g, 100), 4) AS rank FROM g WHERE g IS NULL OR g > 1.5 ORDER BY rank DESC, term LIMIT 50""")
def emerging_terms(spark, d):
    docs = _documents(spark, d).withColumnRenamed("source", "period")
    return text.emerging(text.document_counts(docs, "abstract", keep=("period",)))


@query()
def doc_keywords(spark, d):
    docs = _documents(spark, d).withColumn("title", F.element_at(F.split("abstract", "\n"), 1))
    return text.doc_keywords(docs, stop=["the", "and", "that"], merges={"thth": "the"}).select("arxiv_id", F.array_join("keywords", "|").alias("keywords"))


# --- full text --------------------------------------------------------------------------------------------------------
@query("SELECT doc_id AS arxiv_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines FROM documents")
def structure_stats(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("arxiv_id"), "text")
    return fulltext.structure(docs).select("arxiv_id", F.col("chars").cast("long").alias("chars"), F.col("lines").cast("long").alias("lines"))


def _any_sql(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


_HEADER = " ".join(f"WHEN regexp_matches(t, '(?i){_any_sql(ps)}') THEN '{name}'" for name, ps in L.SECTIONS.items())
_WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
h AS (SELECT *, CASE {_HEADER} END AS h FROM (SELECT *, trim(line, {_WHITE}) AS t FROM l)), n AS (SELECT *, count(h) OVER (PARTITION BY doc_id ORDER BY i) AS ord FROM h),
p AS (SELECT doc_id, ord, coalesce(max(h), 'preamble') AS section, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (h IS NULL), ''), {_WHITE}) AS content FROM n GROUP BY ALL),
s AS (SELECT doc_id, section, arg_max(content, ord) AS content FROM p WHERE content <> '' GROUP BY ALL) SELECT section, count(*) AS n, round(avg(length(content)), 4) AS avg_chars FROM s GROUP BY section""")
def sections(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("arxiv_id"), "text")
    return fulltext.section_frequency(fulltext.sections(docs))


def _named_sql(named: dict[str, list[str]], out: str) -> str:
    """Documents for each name: any of its patterns between word borders, as letters of all scripts have them."""
    edge = lambda p: p.replace(r"\b", r"(?:^|$|[^\p{L}\p{N}_])")
    rows = " UNION ALL ".join(f"SELECT '{k}' AS {out}, count(*) FILTER (regexp_matches(low, '{edge(_any_sql(ps))}')) AS n FROM d" for k, ps in named.items())
    return f"WITH d AS (SELECT lower(coalesce(text, '')) AS low FROM documents), r AS ({rows}) SELECT * FROM r"


@query(_named_sql({k: [p] for k, p in L.LIMITATION_THEMES.items()}, "theme"))
def limitation_themes(spark, d):
    docs = read(spark, d, "documents").select(fulltext.themes(F.col("text")).alias("themes"))
    return fulltext.theme_counts(docs, names=list(L.LIMITATION_THEMES))


@query(_named_sql(L.CONTRIBUTIONS, "theme"))
def contribution_types(spark, d):
    docs = read(spark, d, "documents").select(text.contributions(F.col("text")).alias("types"))
    return fulltext.theme_counts(docs, "types", list(L.CONTRIBUTIONS))


@query(rf"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[.!?]\s+')) AS s FROM documents), c AS (SELECT doc_id, regexp_replace(trim(s, {_WHITE}), '\s+', ' ', 'g') AS s FROM s WHERE length(trim(s, {_WHITE})) >= 20 AND regexp_matches(s, '(?i){_any_sql(L.DIRECTIONS)}'))
SELECT doc_id AS arxiv_id, CAST(least(count(DISTINCT s), 15) AS INTEGER) AS directions FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id""")
def future_sentences(spark, d):
    docs = read(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("arxiv_id"), F.size(fulltext.future_directions(F.col("text"))).alias("directions"))


@query()
def inline_mentions(spark, d):
    docs = read(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("arxiv_id"), fulltext.mentions(F.col("text"), L.LIMITATION_MENTIONS).alias("limitations"), fulltext.mentions(F.col("text"), L.FUTURE_MENTIONS, 62, 250).alias("future_work"))


# --- co-author and citation graphs ------------------------------------------------------------------------------------
_PAIRS = f"""{P}, r AS (SELECT arxiv_id, unnest(author_list) AS au FROM papers), every_pair AS (SELECT x.au AS a, y.au AS b, count(*) AS w FROM r x JOIN r y ON x.arxiv_id = y.arxiv_id AND x.au < y.au GROUP BY ALL)"""
_ENDS = "s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), dg AS (SELECT a AS id, count(*) AS degree FROM s GROUP BY a)"
_ALL_EDGES = f"{_PAIRS}, e AS (SELECT * FROM every_pair), {_ENDS}"
_STRONG_EDGES = f"""{_PAIRS}, at_w AS (SELECT w, sum(count(*)) OVER (ORDER BY w DESC) AS upto FROM every_pair GROUP BY w), size AS (SELECT count(*) AS nodes FROM (SELECT a FROM every_pair UNION SELECT b FROM every_pair)),
lim AS (SELECT coalesce(min(w) FILTER (upto <= 2 * nodes), max(w)) AS least FROM at_w, size), e AS (SELECT a, b, w FROM every_pair, lim WHERE w >= least), {_ENDS}"""


def _strong(spark, d):
    """The heaviest pairs of co-authors, about two an author: generated papers join nearly all authors, and all pairs are one clique."""
    return graph.strongest(graph.coauthor_edges(papers(spark, d)), 2)


@query(_ALL_EDGES + " SELECT id, degree FROM dg")
def coauthor_degree(spark, d):
    return graph.degrees(graph.coauthor_edges(papers(spark, d)))


@query(_ALL_EDGES + " SELECT count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(avg(degree), 4) AS avg_degree, max(degree) AS max_degree, round(sum(degree) / CAST(count(*) * (count(*) - 1) AS DOUBLE), 6) AS density FROM dg")
def network_stats(spark, d):
    return graph.network_stats(graph.coauthor_edges(papers(spark, d)))


@query(_STRONG_EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + ", c(id, r) AS (SELECT id, id FROM dg UNION SELECT s.b, c.r FROM c JOIN s ON s.a = c.id) SELECT id, min(r) AS component FROM c GROUP BY id")
def components(spark, d):
    return graph.components(_strong(spark, d))


@query(_STRONG_EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + """, c(id, r) AS (SELECT id, id FROM dg UNION SELECT s.b, c.r FROM c JOIN s ON s.a = c.id), k AS (SELECT id, min(r) AS component FROM c GROUP BY id),
z AS (SELECT component, count(*) AS size FROM k GROUP BY 1), i AS (SELECT component, count(*) AS internal FROM e JOIN k ON k.id = e.a GROUP BY 1)
SELECT component, size, internal, round(2 * internal / CAST(size * (size - 1) AS DOUBLE), 4) AS cohesion FROM z JOIN i USING (component) WHERE size >= 3""")
def author_clusters(spark, d):
    return graph.clusters(_strong(spark, d), papers(spark, d))


@query(_ALL_EDGES + " SELECT arxiv_id, count(*) AS team_size, CAST(sum(coalesce(degree, 0)) AS BIGINT) AS team_connections FROM r LEFT JOIN dg ON dg.id = r.au GROUP BY arxiv_id")
def paper_team_metrics(spark, d):
    p = papers(spark, d)
    return graph.team_metrics(p, graph.coauthor_edges(p))


@query(f"""{P} SELECT primary_category, year, count(*) AS n, round(avg(len(author_list)), 4) AS avg_team, round(avg(CAST(len(author_list) = 1 AS DOUBLE)), 4) AS solo_rate FROM papers WHERE author_list IS NOT NULL GROUP BY ALL""")
def collab_patterns(spark, d):
    return graph.collaboration(papers(spark, d))


@query(f"""{P}, z AS (SELECT arxiv_id, CAST(len(list_distinct(list_transform(category_list, lambda x: string_split(x, '#')[1]))) AS INTEGER) AS k, CAST(len(category_list) AS INTEGER) AS m FROM papers WHERE category_list IS NOT NULL)
SELECT arxiv_id, CAST(2 * k + m + CAST(k > 1 AS INTEGER) AS INTEGER) AS score FROM z ORDER BY score DESC, arxiv_id LIMIT 50""")
def bridge_by_category(spark, d):
    return graph.category_bridges(papers(spark, d), separator="#")


@query(_ALL_EDGES + " SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b")
def triangles_cliques(spark, d):
    return graph.triangles(graph.coauthor_edges(papers(spark, d)))


@query()
def maximal_cliques(spark, d):
    return graph.maximal_cliques(_strong(spark, d)).select(F.array_join("clique", ",").alias("clique"))


@query()
def betweenness(spark, d):
    return graph.betweenness(graph.coauthor_edges(papers(spark, d))).select("id", F.round("betweenness", 6).alias("betweenness"))


def _chain(spark, d):
    """Each order cites the same customer's order before it."""
    from pyspark.sql.window import Window as W

    o = read(spark, d, "orders")
    prior = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(F.col("o_orderkey").alias("src"), prior.alias("dst")).where("dst is not null")


_CHAIN = "cite AS (SELECT * FROM (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"


@query(f"{P}, {_CHAIN} SELECT dst AS arxiv_id, count(*) AS in_degree, round(count(*) / CAST(greatest(coalesce(any_value(citations), 0), 1) AS DOUBLE), 3) AS ratio FROM cite LEFT JOIN papers ON arxiv_id = dst GROUP BY dst ORDER BY in_degree DESC, dst LIMIT 50")
def foundational(spark, d):
    return graph.foundational(_chain(spark, d), papers(spark, d))


@query(f"""WITH {_CHAIN}, u AS (SELECT src AS id, 1 AS o, 0 AS i FROM cite UNION ALL SELECT dst, 0, 1 FROM cite), g AS (SELECT id, sum(o) AS o, sum(i) AS i FROM u GROUP BY id)
SELECT count(*) AS nodes, CAST(sum(o) AS BIGINT) AS edges, round(sum(o) / CAST(count(*) * (count(*) - 1) AS DOUBLE), 8) AS density, CAST(max(i) AS BIGINT) AS max_in, CAST(max(o) AS BIGINT) AS max_out, count(*) FILTER (WHERE i = 0) AS sources, count(*) FILTER (WHERE o = 0) AS sinks FROM g""")
def graph_stats(spark, d):
    return graph.graph_stats(_chain(spark, d))


@query(f"""WITH RECURSIVE {_CHAIN}, s AS (SELECT max(src) AS r FROM cite), l(id, depth) AS (SELECT r, 0 FROM s UNION SELECT dst, depth + 1 FROM l JOIN cite ON src = id WHERE depth < 5) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM l GROUP BY id""")
def lineage(spark, d):
    e = _chain(spark, d)
    return graph.lineage(e, e.agg(F.max("src")).first()[0])


@query()
def pagerank(spark, d):
    return graph.pagerank(_chain(spark, d), rounds=8).select("id", F.round("pagerank", 10).alias("pagerank"))


# --- trajectories -----------------------------------------------------------------------------------------------------
@query(f"{H} SELECT arxiv_id, year, n, CAST(sum(n) OVER (PARTITION BY arxiv_id ORDER BY year) AS BIGINT) AS cumulative FROM history")
def citation_history(spark, d):
    return trajectories.cumulative(history(spark, d))


_V = f"""{H}, p AS (SELECT *, min(year) OVER (PARTITION BY arxiv_id) AS pub_year FROM history), g AS (SELECT arxiv_id, pub_year, CAST(sum(n) AS BIGINT) AS total, sum(CASE WHEN year IN ({NOW}, {NOW - 1}) THEN n ELSE 0 END) / 2.0::DOUBLE AS recent, sum(CASE WHEN year IN (pub_year, pub_year + 1) THEN n ELSE 0 END) / 2.0::DOUBLE AS early FROM p GROUP BY ALL),
v AS (SELECT arxiv_id, pub_year, total, round(total / greatest(0.1, CAST({NOW} - pub_year AS DOUBLE)), 2) AS per_year, recent, early, recent - early AS acceleration FROM g)"""


@query(f"""{_V} SELECT *, CASE WHEN acceleration > 0.5 * early AND acceleration > 1 THEN 'accelerating' WHEN acceleration < -0.5 * early AND acceleration < -1 THEN 'decelerating' ELSE 'steady' END AS trend FROM v""")
def velocity(spark, d):
    return trajectories.velocity(history(spark, d), NOW)


@query(f"""{_V} SELECT arxiv_id, total, acceleration, round(acceleration * ln(1 + CASE WHEN early > 0 THEN recent / early ELSE recent + 1 END), 4) AS score FROM v WHERE total >= 5 AND acceleration > 0 ORDER BY score DESC, arxiv_id LIMIT 50""")
def momentum(spark, d):
    return trajectories.momentum(history(spark, d), NOW, accelerating_only=False)


@query(f"""{H}, p AS (SELECT *, min(year) OVER (PARTITION BY arxiv_id) AS p FROM history), g AS (SELECT arxiv_id, p, CAST(sum(n) AS BIGINT) AS total, avg(n) FILTER (WHERE year < p + ({NOW} - p) // 2) AS a, avg(n) FILTER (WHERE year >= p + ({NOW} - p) // 2) AS w FROM p GROUP BY ALL)
SELECT arxiv_id, total, round(w / a, 4) AS ratio, round(w / a * ln(1 + total), 4) AS score FROM g WHERE {NOW} - p >= 3 AND total >= 20 AND a > 0 AND w / a >= 0.9""")
def sleeping(spark, d):
    return trajectories.sleeping_beauties(history(spark, d), NOW, ratio=0.9)


@query(f"""{H}, k AS (SELECT arxiv_id, year AS peak_year, n AS peak, count(*) OVER (PARTITION BY arxiv_id) AS act FROM history QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY n DESC, year) = 1),
g AS (SELECT arxiv_id, peak_year, peak, act, sum(CASE WHEN abs(year - peak_year) <= 1 THEN n ELSE 0 END) / 3.0::DOUBLE AS ar, sum(CASE WHEN year IN ({NOW}, {NOW - 1}) THEN n ELSE 0 END) / 2.0::DOUBLE AS rc FROM history JOIN k USING (arxiv_id) GROUP BY ALL)
SELECT arxiv_id, peak_year, peak, round(rc / ar, 4) AS ratio FROM g WHERE act >= 3 AND peak >= 50 AND peak_year < {NOW - 1} AND rc / ar < 0.9""")
def declining(spark, d):
    return trajectories.declining(history(spark, d), NOW, threshold=0.9)


@query(f"""{H}, x AS (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY year) - 1 AS x FROM history), f AS (SELECT arxiv_id, count(*) AS k, round(coalesce(regr_slope(n, x), 0), 4) AS s, max_by(n, year) AS last, sum(n) AS total, min(year) AS p FROM x GROUP BY arxiv_id),
o AS (SELECT arxiv_id, CAST(i AS INTEGER) AS step, CAST(CASE WHEN k >= 2 THEN greatest(0, round(last + s * i)) ELSE round(total / greatest(0.1, CAST({NOW} - p AS DOUBLE))) END AS BIGINT) AS predicted, total FROM f, range(1, 3) t(i))
SELECT arxiv_id, step, predicted, CAST(total + sum(predicted) OVER (PARTITION BY arxiv_id ORDER BY step) AS BIGINT) AS cumulative FROM o""")
def predict(spark, d):
    return trajectories.predict(history(spark, d), NOW)


@query(f"""{P}, r AS (SELECT arxiv_id, citations, velocity, CASE WHEN paper_age_days / 365.25 < 1 THEN '<1' WHEN paper_age_days / 365.25 < 2 THEN '1-2' WHEN paper_age_days / 365.25 < 3 THEN '2-3' WHEN paper_age_days / 365.25 < 5 THEN '3-5' ELSE '5+' END AS cohort FROM papers WHERE coalesce(citations, 0) >= 10),
k AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY velocity DESC, arxiv_id) AS rank, count(*) OVER (PARTITION BY cohort) AS size FROM r) SELECT arxiv_id, cohort, citations, round(velocity, 4) AS velocity, rank FROM k WHERE size >= 5 AND rank <= greatest(1, size // 10)""")
def breakouts(spark, d):
    return trajectories.breakouts(papers(spark, d))


@query(f"""{H}, c AS (SELECT *, sum(n) OVER (PARTITION BY arxiv_id ORDER BY year) AS cum, min(year) OVER (PARTITION BY arxiv_id) AS p FROM history)
SELECT arxiv_id, CAST(m AS INTEGER) AS mark, min(year) AS year, CAST(min(year) - min(p) AS INTEGER) AS years_taken FROM c, (SELECT unnest([10, 50, 100, 500, 1000]) AS m) WHERE cum >= m GROUP BY ALL""")
def milestones(spark, d):
    return trajectories.milestones(history(spark, d))


@query(f"{H} SELECT year, CAST(sum(n) AS BIGINT) AS citations, count(*) AS cited FROM history GROUP BY year")
def yearly_totals(spark, d):
    return trajectories.yearly_totals(history(spark, d))


# --- benchmark tables -------------------------------------------------------------------------------------------------
@query(f"""{S}, g AS (SELECT task_name, dataset_name, metric_name, count(*) AS n, min_by(metric_value, (evaluation_date, row_id)) AS oldest, max_by(metric_value, (evaluation_date, row_id)) AS latest FROM sota WHERE metric_value IS NOT NULL GROUP BY ALL) SELECT *, latest - oldest AS improvement FROM g WHERE n >= 2""")
def sota_progression(spark, d):
    return benchmarks.progression(sota(spark, d))


@query(f"""{S}, r AS (SELECT *, row_number() OVER (PARTITION BY task_name, dataset_name ORDER BY evaluation_date DESC, row_id DESC) AS rn FROM sota WHERE metric_value IS NOT NULL),
g AS (SELECT task_name, dataset_name, count(*) AS submissions, max(metric_value) FILTER (WHERE rn <= 5) AS a, max(metric_value) FILTER (WHERE rn > 5 AND rn <= 15) AS b FROM r GROUP BY ALL)
SELECT task_name, dataset_name, submissions, round(abs(a - b) / nullif(abs(b), 0), 6) AS change FROM g WHERE submissions >= 10 AND abs(a - b) / nullif(abs(b), 0) < 0.05 ORDER BY submissions DESC, task_name, dataset_name LIMIT 50""")
def solved(spark, d):
    return benchmarks.solved(sota(spark, d), plateau=0.05)


@query(f"""{S}, g AS (SELECT task_name, dataset_name, count(*) FILTER (WHERE evaluation_date >= TIMESTAMP '2024-01-21') AS recent, count(DISTINCT method_name) FILTER (WHERE evaluation_date >= TIMESTAMP '2024-01-21') AS methods,
 max(metric_value) FILTER (WHERE evaluation_date >= TIMESTAMP '2024-01-21') AS a, max(metric_value) FILTER (WHERE evaluation_date < TIMESTAMP '2024-01-21') AS b FROM sota GROUP BY ALL)
SELECT task_name, dataset_name, recent, methods, round((a - b) / nullif(abs(b), 0) * 100, 4) AS improvement_pct FROM g WHERE recent >= 5""")
def active(spark, d):
    return benchmarks.active(sota(spark, d), "2024-01-21")


@query(f"""{S}, b AS (SELECT task_name, dataset_name, count(*) AS submissions FROM sota GROUP BY ALL HAVING count(*) <= 15), t AS (SELECT task_name, count(*) AS task_total FROM sota GROUP BY 1 HAVING count(*) >= 3)
SELECT task_name, dataset_name, submissions, task_total, round(task_total / CAST(submissions AS DOUBLE), 4) AS score FROM b JOIN t USING (task_name)""")
def underserved(spark, d):
    return benchmarks.underserved(sota(spark, d), most=15)


@query(f"""{S}, g AS (SELECT task_name, dataset_name, metric_name, count(*) AS n, min(metric_value) AS worst, max(metric_value) AS best, min(evaluation_date) AS first, max(evaluation_date) AS last FROM sota GROUP BY ALL),
k AS (SELECT task_name, dataset_name, metric_name, method_name, count(*) AS k FROM sota GROUP BY ALL), c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY task_name, dataset_name, metric_name ORDER BY k DESC, method_name) <= 5),
m AS (SELECT task_name, dataset_name, metric_name, string_agg(CAST(method_name AS VARCHAR), ',' ORDER BY k DESC, method_name) AS dominant FROM c GROUP BY ALL) SELECT * FROM g JOIN m USING (task_name, dataset_name, metric_name)""")
def bench_metrics(spark, d):
    return benchmarks.metrics(sota(spark, d))


@query(f"""{S}, r AS (SELECT *, max(metric_value) OVER (PARTITION BY task_name, dataset_name, metric_name ORDER BY evaluation_date, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sota WHERE metric_value IS NOT NULL),
k AS (SELECT * FROM r WHERE before IS NULL OR metric_value > before) SELECT task_name, dataset_name, metric_name, row_id, metric_value,
 CAST(CAST(evaluation_date AS DATE) - CAST(lag(evaluation_date) OVER (PARTITION BY task_name, dataset_name, metric_name ORDER BY evaluation_date, row_id) AS DATE) AS INTEGER) AS days FROM k""")
def improvement_intervals(spark, d):
    return benchmarks.improvements(sota(spark, d))


@query(f"""{S}, b AS (SELECT metric_name, method_name, max(metric_value) AS best, count(*) AS n FROM sota WHERE task_name = 'click' AND dataset_name = 3 GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY metric_name ORDER BY best DESC, method_name) AS INTEGER) AS rank FROM b""")
def method_compare(spark, d):
    return benchmarks.compare_methods(sota(spark, d), "click", 3)


@query(f"""{S}, t AS (SELECT DISTINCT o_orderpriority AS task_name FROM orders UNION SELECT DISTINCT event_type FROM events), n AS (SELECT task_name, count(*) AS n FROM sota GROUP BY 1) SELECT task_name, coalesce(n, 0) AS n FROM t LEFT JOIN n USING (task_name) WHERE coalesce(n, 0) < 3""")
def benchmark_gaps(spark, d):
    tasks = read(spark, d, "orders").select(F.col("o_orderpriority").alias("task_name")).union(read(spark, d, "events").select("event_type")).distinct()
    return benchmarks.gaps(tasks, sota(spark, d))


# --- vectors ----------------------------------------------------------------------------------------------------------
_COS = "list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0)"


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0) SELECT vec_id, round(" + _COS.format(a="e", b="q") + ", 6) AS similarity FROM v, q WHERE vec_id <> 0 ORDER BY similarity DESC, vec_id LIMIT 10")
def similar_topn(spark, d):
    v = read(spark, d, "embeddings")
    return vectors.similar(v, v.where("vec_id = 0").first()["embedding"], exclude=0)


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT x.vec_id, 1 - (" + _COS.format(a="x.e", b="y.e") + ") AS dist, y.vec_id AS o FROM v x JOIN v y ON x.vec_id <> y.vec_id), r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, o) <= 10) SELECT vec_id, round(avg(dist), 4) AS isolation FROM r GROUP BY vec_id")
def knn_isolation(spark, d):
    return vectors.isolation(read(spark, d, "embeddings"))


_GAPS = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT x.vec_id, 1 - (" + _COS.format(a="x.e", b="y.e") + """) AS dist, y.vec_id AS o FROM v x JOIN v y ON x.vec_id <> y.vec_id),
r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, o) <= 10), a AS (SELECT vec_id, avg(dist) AS d, var_pop(dist) AS v FROM r GROUP BY vec_id),
g AS (SELECT vec_id, d, v, (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) AS i, d >= quantile_cont(d, 0.75) OVER () AS sparse, v >= quantile_cont(v, 0.75) OVER () AS boundary FROM a)"""


@query(_GAPS + " SELECT vec_id, round(d, 6) AS avg_distance, round(i, 6) AS isolation, round(1 - i, 6) AS density, round(v, 8) AS variance, sparse, boundary FROM g")
def embedding_gaps(spark, d):
    g = vectors.embedding_gaps(read(spark, d, "embeddings"))
    return g.select("vec_id", *[F.round(c, 6).alias(c) for c in ("avg_distance", "isolation", "density")], F.round("variance", 8).alias("variance"), "sparse", "boundary")


@query(_GAPS + " SELECT count(*) AS n, count(*) FILTER (sparse) AS sparse, count(*) FILTER (boundary) AS boundary, round(1 - avg(i), 6) AS coverage FROM g")
def embedding_coverage(spark, d):
    return vectors.coverage(vectors.embedding_gaps(read(spark, d, "embeddings")))


@query("""WITH r AS (SELECT label AS cluster, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings), c AS (SELECT cluster, count(*) FILTER (WHERE k < floor(n * 0.75)) AS early, count(*) FILTER (WHERE k >= floor(n * 0.75)) AS late, any_value(n) AS n FROM r GROUP BY cluster),
q AS (SELECT *, (late / CAST(n - floor(n * 0.75) AS DOUBLE)) / nullif(early / CAST(floor(n * 0.75) AS DOUBLE), 0) AS ratio FROM c) SELECT cluster, early, late, round(ratio, 4) AS ratio, CASE WHEN early = 0 THEN 'new' WHEN ratio > 1.5 THEN 'emerging' WHEN ratio < 0.7 THEN 'declining' ELSE 'stable' END AS state FROM q""")
def emerging_clusters(spark, d):
    return vectors.cluster_shift(read(spark, d, "embeddings"))


@query()
def kmeans(spark, d):
    return vectors.kmeans(read(spark, d, "embeddings"), 10)


@query("WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE 1 - (" + _COS.format(a="x.e", b="y.e") + ") <= 0.62), c(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, c.r FROM c JOIN p ON p.a = c.vec_id) SELECT vec_id, min(r) AS component FROM c GROUP BY vec_id")
def single_linkage(spark, d):
    return linkage.within(read(spark, d, "embeddings"), 0.62)


@query()
def agglomerative_clusters(spark, d):
    v = read(spark, d, "embeddings")
    return linkage.centre_distances(v, linkage.clusters(v, 10)).withColumn("distance", F.round("distance", 6))


@query()
def neighbour_landscape(spark, d):
    return landscape.landscape(read(spark, d, "embeddings"))


@query()
def pca_landscape(spark, d):
    return vectors.landscape(read(spark, d, "embeddings"))


# Names of earlier forms over all rows; their queries read all rows themselves now.
for _name in ("keyword_counts", "lexicon_hits", "novelty_score", "tfidf_topn", "cooccurrence", "corpus_topics", "emerging_terms", "doc_keywords", "coauthor_degree", "network_stats", "paper_team_metrics"):
    QUERIES[f"{_name}_all"] = QUERIES[_name]
    if _name in ORACLE_SQL:
        ORACLE_SQL[f"{_name}_all"] = ORACLE_SQL[_name]
