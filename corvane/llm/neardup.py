"""Near-duplicates by b-bit MinHash: banded candidates, bit-counted estimates, exact confirmation on full sets.

A document's set is its distinct five-word shingles. ``HASHES`` minima are taken; ``BANDS`` groups of ``ROWS`` minima
make the band keys, and the low ``BITS`` bits of all minima are packed as the signature. Texts with equal sets form one
class, which is one vertex from then on: what is linked are classes, so ids may repeat or be null. Two classes that share
a band key are candidates; their similarity is estimated from the signatures' equal fields, less the 2**-BITS that agree
by chance, and a pair far below the threshold (``SLACK``) is left. The rest is confirmed on the full sets of shingles,
computed anew from the texts.

Only who is connected matters for the result, so no group's pairs are all made. First every class is compared with one
other: the likeliest of the leads of its buckets. Those still apart are compared with another one; a connected bucket is done. What then still lies in one bucket but in different components is compared pair by pair in the
join's condition: exact, and little is left. No link that the bands find is lost.
At similarity 0.85, 24 bands of 5 miss a link with probability 1e-6, at 0.8 with 7e-5.

Null text or no words: no shingles, linked with nothing. Fewer than five words: the whole sequence is one shingle.
Very long text: worked on alone, whole. Null id: linked like any other; a component's id is its smallest id that is not
null, or null if it has none. Repeated ids with different texts: each text is linked for itself. Repeated rows: each row is
returned. Ties: the smallest id. Other columns are never read, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded_broadcast, free_name, rows_of, save, small_batches, sweep, tidy
from .graph import components
from .vectext import Words, blocks, mix, shingles

HASHES, BANDS, ROWS, BITS = 384, 24, 5, 4
#: A pair is confirmed if its estimate is at least the threshold less this: over four deviations of the estimate, which
#: leaves about as many links as the bands miss (1e-5 of the pairs at similarity 0.85, 7e-5 at 0.8).
SLACK = 0.083
SHINGLE = 5

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)

SIGNATURES = "id long, row long, n_shingles long, set_a long, set_b long, bands array<long>, packed array<long>"
#: Leads of its buckets with which a class is compared in one turn. What these leave apart the last turn compares in full.
LEADS = 3
#: Pairs that meet one text in one task at most, in the confirmation.
PAIRS_A_TASK = 200


def signature_rows(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of a run of texts: distinct shingles, two set hashes, band keys and packed low bits of each."""
    s, doc = shingles(Words(texts), SHINGLE)
    n = len(texts)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    if len(s):
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])))
        s, doc = s[new], doc[new]
    count = np.bincount(doc, minlength=n)
    full = np.flatnonzero(count)
    first = np.searchsorted(doc, full)
    set_a, set_b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    minima = np.zeros((HASHES, n), np.uint64)
    if len(full):
        set_a[full] = np.add.reduceat(mix(s + np.uint64(11)), first)
        set_b[full] = np.add.reduceat(mix(s ^ np.uint64(0xABCDEF0123456789)), first)
        for i in range(HASHES):
            minima[i, full] = np.minimum.reduceat(s * _MUL[i] + _ADD[i], first)
    bands = np.zeros((n, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(n, b, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0xD1342543DE82EF95) + minima[b * ROWS + r])
        bands[:, b] = key
    low = mix(minima) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    packed = np.zeros((n, HASHES // per), np.uint64)
    for i in range(HASHES):
        packed[:, i // per] |= low[i] << np.uint64(BITS * (i % per))
    return count, set_a, set_b, bands, packed


def signatures(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    def compute(frames):
        for f in frames:
            ids, row = f["id"].astype("Int64").array, f["row"].to_numpy()
            for first, part in blocks(list(f["text"])):
                count, a, b, bands, packed = signature_rows(part)
                out = pd.DataFrame({"id": ids[first : first + len(part)], "row": row[first : first + len(part)], "n_shingles": count.astype(np.int64), "set_a": a.view(np.int64), "set_b": b.view(np.int64)})
                out["bands"] = list(bands.view(np.int64))
                out["packed"] = list(packed.view(np.int64))
                yield out

    small_batches(docs.sparkSession)
    return _rows(docs, id_column, text).mapInPandas(tidy(compute), SIGNATURES)


def _rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, text, and row: 64 bits of the text, by which the confirmation finds it again."""
    return docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("row"), "text")


def estimate(x: Column, y: Column) -> Column:
    """Similarity from two packed signatures: the share of equal fields, corrected for those equal by chance."""
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    ones = ones - (1 << 64) if ones >> 63 else ones
    differ = F.lit(0)
    for i in range(HASHES * BITS // 64):
        d = x[i].bitwiseXOR(y[i])
        any_bit = d
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(d, k))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(ones).cast("long")))
    chance = 2.0**-BITS
    return ((1 - differ / float(HASHES)) - chance) / (1 - chance)


def _similar(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) with the texts' numbers (ra, rb) those with den * |intersection| >= num * |union| on full sets.

    A text that many pairs share is sent to several tasks, ``PAIRS_A_TASK`` pairs to each, and cut into shingles once there.
    """

    def sets(texts: list) -> list[np.ndarray]:
        out = []
        for _, part in blocks(texts):
            s, doc = shingles(Words(part), SHINGLE)
            edge = np.searchsorted(doc, np.arange(len(part) + 1))
            out += [np.unique(s[edge[d] : edge[d + 1]]) for d in range(len(part))]
        return out

    def confirm(frames):
        known, y = None, np.zeros(0, np.uint64)
        for f in frames:
            keep = np.zeros(len(f), bool)
            hubs, xs = f["rb"].to_numpy(), sets(list(f["ta"]))
            for i, x in enumerate(xs):
                if hubs[i] != known:
                    known, (y,) = hubs[i], sets([f["tb"].iloc[i]])
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = same > 0 and den * same >= num * (len(x) + len(y) - same)
            yield f.loc[keep, ["a", "b"]]

    hubs = pairs.groupBy(F.col("rb").alias("row")).agg(F.count(F.lit(1)).alias("n"))
    wanted = save(pairs.select(F.col("ra").alias("row"), F.lit(0).alias("n")).unionByName(hubs).groupBy("row").agg(F.ceil(F.max("n") / PAIRS_A_TASK).cast("int").alias("parts")), "wanted")
    texts = texts.join(bounded_broadcast(wanted), "row").groupBy("row").agg(F.max("parts").alias("parts"), F.first("text").alias("text"))
    texts = save(texts, "texts")
    left = texts.select(F.col("row").alias("ra"), F.col("text").alias("ta"))
    right = texts.where("parts > 0").select(F.col("row").alias("rb"), "parts", F.col("text").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    parts = wanted.where("parts > 0").select(F.col("row").alias("rb"), "parts")
    dealt = pairs.join(parts, "rb").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    joined = dealt.join(left, "ra").join(right.drop("parts"), ["rb", "part"])
    return joined.select("a", "b", "rb", "ta", "tb").mapInPandas(tidy(confirm), "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """id, n_shingles, component_id, kept, n_links of every row; linked are sets with den * both >= num * either.

    kept: the row has its component's id (rows of a component without an id are all kept). n_links: confirmed links of
    the document's class that joined components (not all links of a group are made).
    """
    sigs, known = linked(docs, id_column, text, num, den)
    out = sigs.select("id", "n_shingles", "set_a", "set_b").join(bounded_broadcast(known), (F.col("set_a") == F.col("ka")) & (F.col("set_b") == F.col("kb")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("ka").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def linked(docs: DataFrame, id_column: str, text: str, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Saved tables: the rows' signatures, and of each class of several rows or with links (ka, kb) its component.

    component: 64 bits that its classes share; component_id: its smallest id; first_id and first_row: the row to keep, the
    one with the smallest id, then the smallest number of its text.
    """
    spark = docs.sparkSession
    sigs = save(signatures(docs, id_column, text), "signatures")
    texts = _rows(docs, id_column, text).select("row", "text")
    linkable = sigs.where("n_shingles > 0")
    # v, the vertex, is half of a class's hash: among vertices with links, two alike are not to be expected.
    lead = F.struct(F.col("id").isNull().alias("z"), "id", "row")
    classes = save(linkable.groupBy("set_a", "set_b").agg(F.min(lead).alias("lead"), F.count(F.lit(1)).alias("copies")).withColumn("v", F.col("set_a")), "classes")
    # row: any text of the class, since all of them have the same shingles.
    heads = save(linkable.select(F.col("set_a").alias("v"), "set_b", "row", "bands", "packed").dropDuplicates(["v", "set_b"]).drop("set_b"), "heads")
    banded = heads.select("v", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = save(banded.join(shared, "key"), "buckets")
    # A bucket's lead is the class that meets most others in all of its buckets: of copies of one text most likely that text.
    meets = buckets.groupBy("v").agg(F.sum("n").alias("meets"))
    leads = buckets.join(meets, "v").groupBy("key").agg(F.max(F.struct("meets", "v")).alias("lead")).select("key", F.col("lead.v").alias("lead"))
    side = lambda x: heads.select(F.col("v").alias(x), F.col("row").alias(f"r{x}"), F.col("packed").alias(f"p{x}"))
    floor = num / den - SLACK

    def likely(pairs: DataFrame) -> DataFrame:
        """One pair for each a at most: of the ``LEADS`` b with most buckets in common the likeliest, if near the threshold or above."""
        order = W.partitionBy("a").orderBy(F.desc("n"), F.xxhash64("a", "b"))
        few = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= LEADS).drop("n", "r")
        p = few.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", estimate(F.col("pa"), F.col("pb")).alias("e")).where(F.col("e") >= floor)
        return p.groupBy("a").agg(F.max(F.struct("e", "b", "ra", "rb")).alias("best")).select("a", "best.b", "best.ra", "best.rb")

    links = tested = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "id long, component long")
    for turn in ("first", "other", "rest"):
        sweep(spark)
        if turn == "first":
            pairs = likely(buckets.join(leads, "key").where("v <> lead").select(F.col("v").alias("a"), F.col("lead").alias("b")))
        else:
            part = labels.withColumnRenamed("id", "lid")
            placed = buckets.join(part, F.col("v") == F.col("lid"), "left").select("key", "v", F.coalesce("component", "v").alias("component"))
            split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct(F.xxhash64("v", "key").alias("h"), "v", "component")).alias("lead")).where("lo <> hi").select("key", "lead")
            placed = save(placed.join(split, "key"), "split")
            if turn == "other":
                pairs = likely(placed.where("component <> lead.component").select(F.col("v").alias("a"), F.col("lead.v").alias("b")))
            else:
                # The estimate stands in the join's condition: pairs that it rules out are never made into rows.
                # So does the first key they share, before it: each pair is estimated and made once.
                placed = placed.join(heads, "v")
                x = placed.select(F.col("key").alias("kx"), F.col("v").alias("a"), F.col("component").alias("ca"), F.col("row").alias("ra"), F.col("packed").alias("pa"), F.col("bands").alias("ba"))
                y = placed.select(F.col("key").alias("ky"), F.col("v").alias("b"), F.col("component").alias("cb"), F.col("row").alias("rb"), F.col("packed").alias("pb"), F.col("bands").alias("bb"))
                once = F.coalesce(*[F.when(F.col("ba")[i] == F.col("bb")[i], F.col("ba")[i]) for i in range(BANDS)]) == F.col("kx")
                pairs = x.join(y, (F.col("kx") == F.col("ky")) & (F.col("ca") < F.col("cb")) & once & (estimate(F.col("pa"), F.col("pb")) >= floor)).select("a", "b", "ra", "rb")
        if turn != "first":
            pairs = pairs.join(tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
        pairs = save(pairs, "pairs")
        if rows_of(pairs):
            tested = tested.unionByName(pairs.select("a", "b"))
            found = save(_similar(pairs, texts, num, den), "links")
            if rows_of(found):
                links = links.unionByName(found)
                # What is known goes in as stars: fewer rounds than from all links anew.
                labels = components(found.unionByName(labels.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))))
    sweep(spark)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    # The component of each class; only classes of several rows or with links need the join.
    placed = classes.join(labels.withColumnRenamed("id", "v"), "v", "left").where("copies > 1 or component is not null")
    placed = save(placed.select("v", F.col("set_a").alias("ka"), F.col("set_b").alias("kb"), "lead", F.coalesce("component", "v").alias("component")), "placed")
    first = placed.groupBy("component").agg(F.min("lead").alias("first"))
    known = placed.drop("lead").join(first, "component").join(degree.withColumnRenamed("id", "v"), "v", "left")
    return sigs, save(known.select("ka", "kb", "component", F.col("first.id").alias("component_id"), F.col("first.row").alias("first_row"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "known")


def thinned(docs: DataFrame, id_column: str = "doc_id", text: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each group one row stays, of repeated rows as well.

    Rows without a word are linked with nothing and stay. A row is known by its id with its text.
    """
    sigs, known = linked(docs, id_column, text, num, den)
    hit = sigs.join(bounded_broadcast(known), (F.col("set_a") == F.col("ka")) & (F.col("set_b") == F.col("kb")) & (F.col("n_shingles") > 0))
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("row") == F.col("first_row"))
    # Rows of groups: gone, or repeated so often that one of them must be picked.
    found = hit.groupBy("id", "row").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    number, id_, row_ = (free_name(c, docs.columns) for c in ("__number", "__id", "__row"))
    found = save(found.where("not stays or n > 1").select(F.col("id").alias(id_), F.col("row").alias(row_), "stays"), "near-duplicates")
    rows = docs.withColumn(number, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = F.col(id_column).cast("long").eqNullSafe(F.col(id_)) & (F.col(number) == F.col(row_))
    rest = rows.join(bounded_broadcast(found), same, "left_anti").select(*docs.columns)
    again = save(found.where("stays").drop("stays"), "repeated")
    if not rows_of(again):
        return rest
    return rest.unionByName(rows.join(bounded_broadcast(again), same, "left_semi").dropDuplicates([id_column, number]).select(*docs.columns))
