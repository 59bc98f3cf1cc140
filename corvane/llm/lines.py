"""Line deduplication by content-defined chunks and by runs of lines; DataFrame functions only.

A text's lines are hashed; a polynomial hash rolls over the last ``window`` of them, and a chunk ends where it is
divisible by ``divisor``. A long line (over ``long_words`` words) is a chunk of its own. The places depend on the lines
alone, so inserted lines shift no other boundary. A chunk counts if it has at least ``least_lines`` lines and
``least_words`` words, or is such a long line.

Chunks leave the edges of a repeated passage, so runs count too: for each line with a word the shortest run of over
``long_words`` words that starts with it (also with the blank lines before it) and the shortest one that ends with it.
Any longer repeated run is made up of these, so it goes whole; only blank lines at its outer edges may stay.
Of chunks and runs with equal bytes the first (by id, then place) stays; one that overlaps the first stays with it.

Equality: by the SHA-256 of the lines' SHA-256; only those whose 64-bit hash repeats are grouped, on the map side first.

A document is an id with its text: rows that share an id but not the text, or have none, are documents of their own.
Null text: stays null. Empty text: one empty line, stays. Very long text: one row, its arrays are as long as its lines and
words. Repeated rows (same id, same text) are one document and are cut alike; of copies under different ids the smallest
keeps its lines, nulls last; ties between texts under one id go by the key. Empty table: empty result. Other columns pass
through unread, but for those named like the output's. removed_chunks counts the pieces taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded_broadcast, free_name, row_key, save

WINDOW, DIVISOR, LONG_WORDS, LEAST_LINES, LEAST_WORDS = 2, 2, 50, 2, 20
_PRIME, _MOD = 1_000_003, (1 << 31) - 1


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"[ \t\x0B\f\r]+"), lambda w: w != ""))


def cuts_of(lines: Column, hashes: Column, words: Column, window: int = WINDOW, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> Column:
    """Where chunks end (number of the last line, from 1) over parallel arrays of a text's lines, hashes and word counts."""
    n = F.size(lines)
    small = lambda i: F.pmod(F.element_at(hashes, i), F.lit(_MOD))

    def ends(i: Column) -> Column:
        rolled = small(i)
        for k in range(1, window):
            rolled = rolled + F.when(i > k, small(F.greatest(i - k, F.lit(1))) * pow(_PRIME, k, _MOD)).otherwise(F.lit(0))
        long_here = F.element_at(words, i) > long_words
        long_next = F.element_at(words, F.least(i + 1, n)) > long_words
        return (F.pmod(rolled, F.lit(_MOD)) % divisor == 0) | long_here | long_next | (i == n)

    return F.filter(F.sequence(F.lit(1), n), ends)


def _place(start: Column, end: Column) -> Column:
    """A range of lines (end exclusive) as one number, so that array_distinct can hash it."""
    return start.cast("long") * (1 << 32) + end.cast("long")


def runs_of(by_word: Column, firsts: Column, long_words: int = LONG_WORDS) -> Column:
    """The shortest runs of over long_words words from and up to each line, as places; null where the text is too short.

    by_word: the line (from 0) of each word; firsts: the index in it of each line's first word.
    """
    end = lambda p: F.get(by_word, p) + 1
    from_line = F.transform(firsts, lambda p: _place(F.get(by_word, p), end(p + long_words)))
    from_blank = F.transform(firsts, lambda p: _place(F.coalesce(end(p - 1), F.lit(0)), end(p + long_words)))
    last = lambda k: F.coalesce(F.get(firsts, k + 1), F.size(by_word)) - 1
    up_to = F.transform(firsts, lambda p, k: _place(F.get(by_word, last(k) - long_words), end(last(k))))
    return F.concat(from_line, from_blank, up_to)


def _units(docs: DataFrame, id_column: str, text: str, window: int, divisor: int, long_words: int, least_lines: int, least_words: int) -> DataFrame:
    """One row for each chunk or run that counts: doc (z, id, key), start, end (exclusive), digest; each step in its own projection, so it runs once.

    explode_outer: from explode, Catalyst infers a filter on the array and pushes it below the projections that make it,
    where the array's steps are nested into each other and run again for each element.
    """
    out = docs.where(F.col(text).isNotNull()).select(F.struct(F.col(id_column).isNull().alias("z"), F.col(id_column).alias("id"), row_key(F.col(id_column), F.col(text)).alias("key")).alias("doc"), F.split(F.col(text), "\n").alias("lines"))
    out = out.select("doc", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", lambda x: F.sha2(x, 256)).alias("digests"), F.transform("lines", _words).alias("words"))
    # A line counts as long_words + 1 words at most: which sums are over long_words stays the same.
    by_word = F.flatten(F.transform("words", lambda w, i: F.array_repeat(i, F.least(w, F.lit(long_words + 1)))))
    out = out.withColumn("cuts", cuts_of(F.col("lines"), F.col("hashes"), F.col("words"), window, divisor, long_words)).withColumn("by_word", by_word)
    first = lambda p: ~F.get("by_word", p).eqNullSafe(F.get("by_word", p - 1))
    out = out.withColumn("firsts", F.filter(F.sequence(F.lit(0), F.greatest(F.size("by_word") - 1, F.lit(0))), first))
    start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.element_at("cuts", F.greatest(j, F.lit(1))))
    places = F.concat(F.transform("cuts", lambda e, j: _place(start(j), e)), runs_of(F.col("by_word"), F.col("firsts"), long_words))
    out = out.withColumn("places", F.array_distinct(places)).select("doc", "digests", "words", F.explode_outer("places").alias("place")).where("place is not null")
    out = out.select("doc", "digests", "words", F.shiftright("place", 32).cast("int").alias("start"), F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("end"))
    part = lambda c: F.slice(c, F.col("start") + 1, F.col("end") - F.col("start"))
    count = F.aggregate(part("words"), F.lit(0), lambda a, b: a + b)
    out = out.select("doc", "start", "end", F.unhex(F.sha2(F.array_join(part("digests"), ""), 256)).alias("digest"), count.alias("words"))
    return out.where(((F.col("end") - F.col("start") >= least_lines) & (F.col("words") >= least_words)) | (F.col("words") > long_words)).drop("words")


def _merged(ranges: DataFrame) -> DataFrame:
    """Ranges (key, start, end) with those that overlap or touch joined into one."""
    by = W.partitionBy("key").orderBy("start", "end")
    out = ranges.distinct().withColumn("upto", F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)))
    out = out.withColumn("part", F.count_if(F.col("upto").isNull() | (F.col("start") > F.col("upto"))).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return out.groupBy("key", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def dedup_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", out: str = "text", window: int = WINDOW, divisor: int = DIVISOR, long_words: int = LONG_WORDS, least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS,
    counts: tuple[str | None, str | None, str | None] = ("n_lines", "removed_chunks", "removed_lines"),
) -> DataFrame:
    """All rows and columns with ``out`` the text without repeated chunks and runs, and three counts, of names ``counts`` (None: left out)."""
    found = save(_units(docs, id_column, text, window, divisor, long_words, least_lines, least_words), "units").withColumn("hash", F.xxhash64("digest"))
    often = save(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated")
    again = found.join(bounded_broadcast(often), "hash", "left_semi").select("digest", "start", "end", "doc")
    first = F.min(F.struct("doc", "start", "end")).alias("first")
    firsts = save(again.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.col("first.doc.key").alias("first"), F.col("first.end").alias("upto")), "firsts")
    drop = again.join(bounded_broadcast(firsts), "digest").where((F.col("doc.key") != F.col("first")) | (F.col("start") >= F.col("upto"))).select("doc.key", "start", "end")
    gone = save(_merged(drop).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone")), "gone")
    key, cut, held = (free_name(c, docs.columns) for c in ("__key", "__gone", "__lines"))
    joined = docs.withColumn(key, row_key(F.col(id_column), F.col(text))).join(bounded_broadcast(gone).select(F.col("key").alias(key), F.col("gone").alias(cut)), key, "left")
    lines = F.split(F.col(text), "\n")
    # Between two ranges that go: from the end of one to the start of the next.
    n = F.size(cut)
    edge = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(cut, F.greatest(i, F.lit(1)))["end"])
    upto = lambda i: F.when(i == n, F.size(held)).otherwise(F.element_at(cut, F.least(i + 1, n))["start"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(held, edge(i) + 1, upto(i) - edge(i))))
    joined = joined.withColumn(held, F.when(F.col(cut).isNotNull() & F.col(text).isNotNull(), lines))
    clean = F.when(F.col(held).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    removed = F.aggregate(cut, F.lit(0), lambda a, x: a + x["end"] - x["start"])
    n_lines = F.when(F.col(text).isNotNull(), F.size(lines))
    made = (n_lines, F.when(F.col(held).isNotNull(), n).otherwise(0), F.when(F.col(held).isNotNull(), removed).otherwise(0))
    others = [F.col(c) for c in docs.columns if c not in (out, *counts)]
    return joined.select(*others, clean.alias(out), *[m.alias(c) for c, m in zip(counts, made, strict=True) if c])
