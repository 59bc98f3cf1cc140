"""Benchmark decontamination by SimHash of item-sized windows, multi-index Hamming blocks and exact verification.

Words are runs of letters and digits, lower-cased. A window of a text is compared with the items that have as many
words; a text shorter than an item is one window. Windows are taken where they can match: a window similar to an item has,
among its first (n - 4) / 9 shingles and one, a shingle of that item (similarity 0.8 leaves no more than a ninth of the
window unshared), so only such windows, at most (n - 4) / 9 + 1 for each shared shingle, are fingerprinted; no other window
can pass the verification. ``anchored=False`` fingerprints every window instead, for tests and measurements.
A fingerprint is 64 bits of SimHash over the shingles, each weighted by how often it occurs. It is cut into ``BLOCKS``
blocks: of two fingerprints within the radius, some block differs in radius / BLOCKS bits at most, so an item stands in the
index under all values that near to its own block, and joining by (words, block, bits) finds every fingerprint within the
radius. What is found is verified by the exact weighted similarity: sum of the smaller over sum of the larger shingle counts.

A text is known by itself, not by its id: rows with equal texts, whatever their ids, get the same result, worked out once.
Null or wordless text or item: matches nothing. An item or window of fewer words than a shingle is one shingle. Very long
texts: all windows that can match; very long items: counted in wider lanes. Repeated items each count. Null or repeated ids:
judged by their texts. Other columns: never read, or passed through, whatever their names. Empty tables: all clean.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, free_name, save, text_key

SHINGLE, NUM, DEN = 5, 80, 100
#: At similarity 0.8 two fingerprints differ in 9.7 bits of 64 on average, with deviation 2.9; 20 is 3.5 deviations on.
#: Seven blocks of nine or ten bits: two flips for each, about 320 rows of index for an item, which meet 63 % of the pairs once.
RADIUS, BLOCKS = 20, 7
#: Files of what the benchmark alone gives.
FILES = 16


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def runs_of(hashes: Column, k: int) -> Column:
    """Hashes of all runs of k words, by place; empty if there are fewer words."""
    n = F.size(hashes)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, k)))).otherwise(F.array().cast("array<bigint>"))


def numbered(shingles: Column) -> Column:
    """Hashes with repeated ones told apart by their number, so that the intersection of two sets is that of the multisets."""
    s = F.array_sort(shingles)
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), shingles).otherwise(F.transform(s, lambda x, i: F.when(F.array_position(s, x) == i + 1, x).otherwise(F.xxhash64(x, i + 1 - F.array_position(s, x)))))


def fingerprinted(df: DataFrame, shingles: str, most: int) -> DataFrame:
    """With column ``fp``, the SimHash of a column of at most ``most`` shingle hashes: bit i is set if more than half have it.

    The bits are counted in lanes of a long: four of 16 bits, or two of 32 where there are more shingles than those hold.
    """
    per = 4 if most < 1 << 15 else 2
    width, groups = 64 // per, 64 // per
    lanes = F.array(*[F.lit(sum(((v >> i) & 1) << (width * i) for i in range(per))).cast("long") for v in range(1 << per)])
    part = lambda x, g: F.shiftrightunsigned(x, per * g).bitwiseAND(F.lit((1 << per) - 1)).cast("int") + 1
    zero = F.array(*[F.lit(0).cast("long")] * groups)
    counts = F.aggregate(shingles, zero, lambda acc, x: F.array(*[F.element_at(acc, g + 1) + F.element_at(lanes, part(x, g)) for g in range(groups)]))
    out, n = F.lit(0).cast("long"), F.size(shingles)
    for g in range(groups):
        for i in range(per):
            lane, bit = F.shiftrightunsigned(F.element_at("__lanes", g + 1), width * i).bitwiseAND(F.lit((1 << width) - 1)), per * g + i
            out = out.bitwiseOR(F.when(lane * 2 > n, F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return df.withColumn("__lanes", counts).withColumn("fp", out).drop("__lanes")


def block_spans(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of blocks that cover 64 bits, of as equal widths as can be."""
    spans, at = [], 0
    for b in range(blocks):
        width = 64 // blocks + (b < 64 % blocks)
        spans.append((at, width))
        at += width
    return spans


def _bits(fp: Column, span: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, span[0]).bitwiseAND(F.lit((1 << span[1]) - 1).cast("long"))


def near_pairs(windows: DataFrame, items: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(key, item_id, distance): all pairs of windows (key, words, fp) and items (item_id, words, fp) of as many words within the radius."""
    spans, flips = block_spans(blocks), radius // blocks
    around = [F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << w) - 1).cast("long")), lambda x: F.bit_count(x) <= flips) for _, w in spans]
    probes = F.flatten(F.array(*[F.transform(around[b], lambda x: F.struct(F.lit(b).alias("block"), _bits(F.col("fp"), spans[b]).bitwiseXOR(x).alias("bits"))) for b in range(blocks)]))
    index = items.select("item_id", F.col("words").alias("iw"), F.col("fp").alias("ifp"), F.explode(probes).alias("p")).select("item_id", "iw", "ifp", F.col("p.block").alias("iblock"), F.col("p.bits").alias("ibits"))
    left = windows.select("key", "words", "fp", F.posexplode(F.array(*[_bits(F.col("fp"), s) for s in spans])).alias("block", "bits"))
    differ = F.col("fp").bitwiseXOR(F.col("ifp"))
    first = F.lit(-1)
    for b in reversed(range(blocks)):  # the first block by which they meet: each pair once
        first = F.when(F.bit_count(_bits(differ, spans[b])) <= flips, b).otherwise(first)
    meet = (F.col("words") == F.col("iw")) & (F.col("block") == F.col("iblock")) & (F.col("bits") == F.col("ibits"))
    return left.join(bounded_broadcast(save(index, "blocks")), meet & (F.bit_count(differ) <= radius) & (first == F.col("block"))).select("key", "item_id", F.bit_count(differ).alias("distance"))


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_column: str = "item_id", item_text: str = "text", num: int = NUM, den: int = DEN, radius: int = RADIUS, anchored: bool = True) -> DataFrame:
    """Matches (key, item_id, words, start, distance, similarity): windows that verify against an item; key is ``text_key``."""
    own = items.where(F.col(item_text).isNotNull()).select(F.col(item_column).alias("item_id"), words_of(F.col(item_text)).alias("w")).where("size(w) > 0")
    own = own.select("item_id", F.size("w").alias("words"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    sizes = [r["words"] for r in own.select("words").distinct().collect()]  # no more than the longest item has words
    widths = sorted({min(n, SHINGLE) for n in sizes})
    if not widths:
        return docs.sparkSession.createDataFrame([], f"key binary, item_id {dict(items.dtypes)[item_column]}, words int, start int, distance int, similarity double")
    shingled = F.lit(None).cast("array<bigint>")
    for k in widths:
        at_k = F.col("words") == k if k < SHINGLE else F.col("words") >= k
        shingled = F.when(at_k, runs_of(F.col("h"), k)).otherwise(shingled)
    own = own.select("item_id", "words", F.least("words", F.lit(SHINGLE)).alias("width"), shingled.alias("sh"))
    own = save(fingerprinted(own, "sh", max(sizes)).withColumn("set", numbered(F.col("sh"))), "items", FILES)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).select(text_key(F.col("t")).alias("id"), words_of(F.col("t")).alias("w"))
    rows = rows.select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    # Shingles of the items, with the window sizes in which they occur.
    anchors = bounded_broadcast(save(own.select("words", "width", F.explode("sh").alias("s")).groupBy("width", "s").agg(F.collect_set("words").alias("sizes")), "anchors", FILES))
    windows = None
    for k in widths:  # posexplode_outer: posexplode brings a filter that is pushed below and makes the array again
        if anchored:
            s = rows.select("id", F.size("h").alias("total"), runs_of(F.col("h"), k).alias("r")).select("id", "total", F.posexplode_outer("r").alias("pos", "s"))
            s = s.join(anchors.where(F.col("width") == k).drop("width"), "s").select("id", "total", "pos", F.explode("sizes").alias("words"))
            spread = F.floor((F.col("words") - k + 1) * (den - num) / (den + num) + 1e-9).cast("int")
            starts = F.sequence(F.greatest(F.col("pos") - spread, F.lit(0)), F.col("pos"))
        else:
            s = rows.select("id", F.size("h").alias("total"), F.explode(F.array(*[F.lit(n) for n in sizes if min(n, SHINGLE) == k])).alias("words"))
            starts = F.sequence(F.lit(0), F.greatest(F.col("total") - F.col("words"), F.lit(0)))
        # A text shorter than the item, but not too short to reach the similarity, is one window.
        enough = (F.col("total") >= k) & ((F.col("total") - k + 1) * den >= (F.col("words") - k + 1) * num)
        starts = F.when(F.col("words") <= F.col("total"), starts).otherwise(F.when(enough, F.array(F.lit(0))))
        s = s.select("id", "total", "words", F.explode(starts).alias("start")).where("start = 0 or start + words <= total").select("id", "words", "start")
        windows = s if windows is None else windows.unionByName(s)
    wanted = save(windows.groupBy("id").agg(F.collect_set(F.struct("words", "start")).alias("at")), "windows")
    # Only texts with such windows are read again, each once; the windows' shingles are slices of the text's.
    again = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).select(text_key(F.col("t")).alias("id"), "t").join(bounded_broadcast(wanted), "id")
    again = again.dropDuplicates(["id"]).select("id", "at", words_of(F.col("t")).alias("w")).select("id", "at", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    parts = None
    for k in widths:
        mine = (lambda x, k=k: x["words"] == k) if k < SHINGLE else (lambda x: x["words"] >= SHINGLE)
        p = again.select("id", F.filter("at", mine).alias("at"), runs_of(F.col("h"), k).alias("r")).select("id", "r", F.explode_outer("at").alias("a")).where("a is not null")
        p = p.select("id", "a.words", "a.start", F.slice("r", F.col("a.start") + 1, F.col("a.words") - k + 1).alias("sh"))
        parts = p if parts is None else parts.unionByName(p)
    # Equal windows (common passages) are fingerprinted and verified once; where they stand is joined last.
    parts = save(parts.withColumn("key", F.xxhash64("words", "sh")), "parts")
    unique = save(fingerprinted(parts.groupBy("key").agg(F.first("words").alias("words"), F.first("sh").alias("sh")), "sh", max(sizes)), "unique")
    near = near_pairs(unique.select("key", "words", "fp"), own.select("item_id", "words", "fp"), radius)
    near = near.join(unique.select("key", "sh"), "key").join(bounded_broadcast(own).select("item_id", "words", "set"), "item_id")
    both = F.size(F.array_intersect("have", "set"))
    near = near.withColumn("have", numbered(F.col("sh"))).select("key", "item_id", "distance", both.alias("both"), (F.size("have") + F.size("set") - both).alias("either"))
    sure = near.where(F.col("both") * den >= F.col("either") * num).select("key", "item_id", "distance", (F.col("both") / F.col("either")).alias("similarity")).distinct()
    sure = bounded_broadcast(save(sure, "verified"))
    return parts.drop("sh").join(sure, "key").select(F.col("id").alias("key"), "item_id", "words", "start", "distance", "similarity")


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each row of docs: its id, contaminated, n_windows, item_ids (sorted) and the highest similarity."""
    found = find(docs, items, text, **how)
    found = found.groupBy("key").agg(F.countDistinct("words", "start", "item_id").alias("n"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("max_similarity"))
    found = bounded_broadcast(save(found, "contaminated"))
    out = docs.select(F.col(id_column).alias("id"), text_key(F.col(text)).alias("key")).join(found, "key", "left")
    return out.select(F.col("id").alias(id_column), F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("item_ids", F.array().cast(f"array<{dict(items.dtypes).get('item_id', 'bigint')}>")).alias("item_ids"), F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"))


def without_matches(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, whose texts match no item."""
    key = free_name("__key", docs.columns)
    found = save(find(docs, items, text, **how).select(F.col("key").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, text_key(F.col(text))).join(bounded_broadcast(found), key, "left_anti").select(*docs.columns)
