"""Readers of landed data: Atom feeds, JSON, CSV, full text, PDFs, service documents; date chunks; look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import lexicon as L

ATOM_SCHEMA = "id string, title string, summary string, published timestamp, updated timestamp, author array<struct<name:string>>, category array<struct<_term:string>>, `arxiv:primary_category` struct<_term:string>, `arxiv:comment` string, `arxiv:doi` string, `arxiv:journal_ref` string, link array<struct<_href:string,_title:string,_rel:string>>"


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def base_id(x: Column) -> Column:
    """Identifier without its version."""
    return F.regexp_replace(x, r"v\d+$", "")


def atom(spark: SparkSession, path: str, default_category: str | None = None) -> DataFrame:
    """Papers from landed Atom feeds; the schema is given, since inference turns single elements into structs."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(ATOM_SCHEMA).load(path)
    vid = F.element_at(F.split("id", "/abs/"), -1)
    cats = F.transform("category", lambda c: c["_term"])
    out = raw.select(
        base_id(vid).alias("arxiv_id"), vid.alias("versioned_id"), F.coalesce(F.regexp_extract(vid, r"v(\d+)$", 1).try_cast("int"), F.lit(1)).alias("version"), squeeze(F.col("title")).alias("title"), squeeze(F.col("summary")).alias("abstract"),
        F.transform("author", lambda a: a["name"]).alias("author_list"), F.to_date("published").alias("published_date"), F.to_date("updated").alias("updated_date"), cats.alias("category_list"),
        F.coalesce(F.col("`arxiv:primary_category`._term"), F.try_element_at(cats, F.lit(1)), F.lit(default_category)).alias("primary_category"), F.col("`arxiv:comment`").alias("arxiv_comment"),
        F.coalesce(F.col("`arxiv:doi`"), F.try_element_at(F.transform(F.filter("link", lambda x: x["_title"] == "doi"), lambda x: x["_href"]), F.lit(1))).alias("doi"), F.col("`arxiv:journal_ref`").alias("journal_reference"),
    )
    return out.withColumns({"month": F.date_format("published_date", "yyyy-MM"), "year": F.year("published_date"), "pdf_url": F.concat(F.lit("https://arxiv.org/pdf/"), "versioned_id", F.lit(".pdf")), "author_count": F.size("author_list"), "is_cross_listed": F.size("category_list") > 1})


def comment_fields(comment: Column) -> dict[str, Column]:
    """Pages, figures, tables and the accepting venue that a comment names."""
    n = lambda word: F.nullif(F.regexp_extract(comment, rf"(?i)(\d+)\s*{word}s?", 1), F.lit("")).cast("int")
    venue = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(comment, "(?i)" + p, 1)), F.lit("")) for p in L.VENUE_MENTIONS])
    return {"page_count": n("page"), "figure_count": n("figure"), "table_count": n("table"), "accepted_venue": venue}


def date_chunks(spark: SparkSession, start: str, end: str, months: int = 24) -> DataFrame:
    """Windows of months * 30 days that cover a span; each begins the day after the one before ends."""
    step = months * 30 + 1
    s = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step} days"))).alias("chunk_start"))
    return s.select("chunk_start", F.least(F.date_add("chunk_start", step - 1), F.lit(end).cast("date")).alias("chunk_end"))


def papers_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def papers_csv(spark: SparkSession, path: str, as_of: Column | None = None) -> DataFrame:
    """Papers from CSV: dates, lists, ages and velocities; empty author strings give no author."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    parts = lambda c, sep: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda x: F.trim(x) != "")
    out = raw.withColumns({"published_date": F.to_date("published_date"), "citations": F.coalesce(F.col("citations").try_cast("long"), F.lit(0))})
    if "authors" in raw.columns:
        out = out.withColumn("author_list", parts("authors", r";\s*"))
    if "all_categories" in raw.columns:
        out = out.withColumn("category_list", parts("all_categories", r",\s*"))
    return with_age(out, F.current_date() if as_of is None else as_of)


def with_age(papers: DataFrame, as_of: Column, days_per_month: float = 30.44) -> DataFrame:
    age = F.datediff(as_of.cast("date"), F.col("published_date"))
    return papers.withColumn("paper_age_days", age).withColumn("citations_per_month", F.round(F.col("citations") / F.greatest(age / days_per_month, F.lit(1.0)), 3))


def fulltext(spark: SparkSession, path: str) -> DataFrame:
    """(arxiv_id, text) from text files named by id."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("arxiv_id"), F.col("value").alias("text"))


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files that begin as PDFs do."""
    return spark.read.format("binaryFile").load(path).where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("path", "content")


def pdf_text(files: DataFrame, package: str = "pdfplumber") -> DataFrame:
    """(path, text, error): text of PDFs by a package that the executors must have; a broken file has its error instead of a text."""

    def read(frames):
        import importlib
        import io

        lib = importlib.import_module(package)
        for f in frames:
            got = []
            for c in f["content"]:
                try:
                    with lib.open(io.BytesIO(c)) as doc:
                        got.append(("\n".join(p.extract_text() or "" for p in doc.pages), None))
                except Exception as e:  # noqa: BLE001  whatever a broken file raises is told in its row
                    got.append((None, f"{type(e).__name__}: {e}"))
            yield f[["path"]].assign(text=[t for t, _ in got], error=[e for _, e in got])

    return files.select("path", "content").mapInPandas(read, "path string, text string, error string")


def existing(spark: SparkSession, folder: str) -> DataFrame:
    """Papers that a collection left in a folder (JSON); an error that says so where there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/papers_json")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"no papers in {folder}: collect some first")
    return spark.read.json(f"{folder}/papers_json")


def statistics_json(spark: SparkSession, path: str) -> DataFrame:
    """Statistics that an analysis wrote."""
    return spark.read.option("multiLine", True).json(path)


def analysis_json(spark: SparkSession, folder: str) -> DataFrame:
    """(name, json): every file of analyses below a folder, by the name of its own folder or file."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(folder)
    parts = F.split(F.input_file_name(), "/")
    last = F.element_at(parts, -1)
    name = F.when(last.startswith("part-"), F.element_at(parts, -2)).otherwise(F.regexp_replace(last, r"\.json$", ""))
    return raw.select(name.alias("name"), F.col("value").alias("json"))


def citations_lookup(papers: DataFrame, service: DataFrame) -> DataFrame:
    """Papers with what a landed citation service says of them: counts, venue, fields, access."""
    s = service.select(
        F.col("arxiv_id"), F.col("citationCount").alias("citations"), F.col("influentialCitationCount").alias("influential_citations"), F.col("referenceCount").alias("reference_count"),
        F.col("fieldsOfStudy").alias("fields_of_study"), F.col("publicationVenue.name").alias("publication_venue"), F.col("openAccessPdf").isNotNull().alias("is_open_access"), F.col("tldr.text").alias("tldr"),
        F.size(F.filter("references", lambda r: F.map_contains_key(r["externalIds"], F.lit("ArXiv")))).alias("reference_arxiv_count"), F.size(F.filter("citations", lambda c: c["citationCount"] > 50)).alias("high_impact_citations"), F.transform("authors", lambda a: a["authorId"]).alias("s2_author_ids"),
    )
    return papers.drop(*[c for c in s.columns if c != "arxiv_id"]).join(s, "arxiv_id", "left")


def backfilled(papers: DataFrame, service: DataFrame, as_of: Column) -> DataFrame:
    """Papers whose missing DOI and affiliations come from a landed service, with citations (none: 0) and their velocity, also of 0.

    service: arxiv_id, citationCount, externalIds (a map), authors (with affiliations); what a paper has itself stays.
    """
    names = F.array_distinct(F.flatten(F.transform("authors", lambda a: F.coalesce(a["affiliations"], F.array().cast("array<string>")))))
    s = service.select("arxiv_id", F.col("citationCount").alias("__n"), F.try_element_at("externalIds", F.lit("DOI")).alias("__doi"), names.alias("__aff")).dropDuplicates(["arxiv_id"])
    out = papers
    for c, kind in (("doi", "string"), ("affiliations", "array<string>")):
        out = out if c in papers.columns else out.withColumn(c, F.lit(None).cast(kind))
    own = F.when(F.size("affiliations") > 0, F.col("affiliations"))
    out = out.drop("citations").join(s, "arxiv_id", "left").withColumns({"doi": F.coalesce(F.nullif("doi", F.lit("")), "__doi"), "affiliations": F.coalesce(own, F.when(F.size("__aff") > 0, F.col("__aff"))), "citations": F.coalesce("__n", F.lit(0))})
    return with_age(out.drop("__n", "__doi", "__aff"), as_of)


def author_metrics(papers: DataFrame, authors: DataFrame, most: int = 5) -> DataFrame:
    """Largest and mean h-index of the first authors, and the first author's own."""
    ids = papers.select("arxiv_id", F.posexplode(F.slice("s2_author_ids", 1, most)).alias("pos", "author_id"))
    m = ids.join(authors, "author_id").groupBy("arxiv_id").agg(F.max("hIndex").alias("max_author_h_index"), F.round(F.avg("hIndex"), 1).alias("avg_author_h_index"), F.max(F.when(F.col("pos") == 0, F.col("hIndex"))).alias("first_author_h_index"), F.max(F.when(F.col("pos") == 0, F.col("citationCount"))).alias("first_author_citation_count"))
    return papers.join(m, "arxiv_id", "left")


def institutions(papers: DataFrame, works: DataFrame, most: int = 10) -> DataFrame:
    """Institutions, countries, funders and concepts from landed works."""
    first = F.slice("authorships", 1, most)
    inst = F.flatten(F.transform(first, lambda a: a["institutions"]))
    w = works.select("arxiv_id", F.array_distinct(F.transform(inst, lambda i: i["display_name"])).alias("institutions"), F.array_sort(F.array_distinct(F.transform(inst, lambda i: i["country_code"]))).alias("institution_countries"), F.array_distinct(F.transform("grants", lambda g: g["funder_display_name"])).alias("funders"), F.slice(F.transform(F.filter("concepts", lambda c: c["score"] > 0.3), lambda c: c["display_name"]), 1, 10).alias("concepts"))
    return papers.join(w, "arxiv_id", "left")


def repositories(papers: DataFrame, repos: DataFrame) -> DataFrame:
    """Most starred repository, number and stars of all, of each paper."""
    r = repos.groupBy(F.col("paper_id").alias("arxiv_id")).agg(F.count(F.lit(1)).alias("repo_count"), F.max_by("url", F.struct("stars", "url")).alias("github_url"), F.max("stars").alias("github_stars"), F.sum("stars").alias("total_github_stars"))
    return papers.drop("github_url", "github_stars").join(r, "arxiv_id", "left").withColumn("has_code", F.col("repo_count").isNotNull())


def fresh(cache: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Rows of a cache table that are young enough."""
    return cache.where(F.col("cached_at") > as_of - F.expr(f"interval {hours} hours"))


def missing(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys that no cache row answers."""
    return keys.join(cache.select(key), key, "left_anti")


def capped(papers: DataFrame, per: str, most: int) -> DataFrame:
    """The newest rows of each category, up to a cap."""
    w = W.partitionBy(per).orderBy(F.desc("published_date"), F.asc("arxiv_id"))
    return papers.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).drop("__rn")
