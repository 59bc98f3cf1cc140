"""The training-data pipeline: language, repeated lines, near-duplicates, benchmark passages, packing.

STAGES are applied in order, each to all that its predecessor kept; every stage but the last returns the columns of
documents. What a stage returns is written as Parquet to the shared folder and read again as the next one's input.

Rows are judged by their texts, never found again by doc_id alone, so null and repeated ids do no harm. Null or empty
text, or one without a letter: goes in language_id. Very long texts are worked on whole. Of repeated rows and of equal or
similar texts, with whatever ids, one row stays (the smallest id, nulls last). Other columns of documents, whatever their
names, pass through to the last stage, which returns pieces. Empty table: each stage returns no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontam, language, lines, neardup, packing
from corvane.llm.common import free_name, save, table
from corvane.llm.queries import tokenizer_path

#: A text stays if at least this share of its n-grams belongs to its language.
LEAST_SCORE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter or in none of the learned languages; lang becomes the predicted one."""
    lang, score = free_name("lang_pred", docs.columns), free_name("score", docs.columns)
    judged = language.predict(docs, language.learn(docs), docs.columns, out_lang=lang, out_score=score)
    good = judged.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return good.withColumn("lang", F.col(lang)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated chunks of lines out; a text of which nothing is left goes. n_chars follows the text."""
    count = free_name("removed_lines", docs.columns)
    clean = lines.dedup_lines(docs, counts=(None, None, count)).where((F.col(count) == 0) | (F.trim("text") != ""))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more) stays."""
    return neardup.thinned(docs, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.without_matches(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their place in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: Bloom filters, chunk hashes, MinHash and the tokenizer aren't SQL; the stages are held against brute force in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
