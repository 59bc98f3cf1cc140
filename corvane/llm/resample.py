"""Importance resampling towards a target: bucket-partitioned inverted postings of hashed n-grams.

A document's features are its runs of 1 to ``MOST_WORDS`` words; each falls into one of ``BUCKETS`` buckets by crc32. Postings
(bucket, document, count) of both corpora are counted inside blocks of texts, packed, and shuffled by ranges of buckets. Where
a range's postings lie, each bucket's occurrences are summed for either corpus; the sums of a bucket meet and give its gain,
the logarithm of how much likelier the target makes it. Each range's postings, with the gains of the range beside them, emit
what they contribute to each document, and contributions are reduced by document. Gumbel noise from the id is added, and the
highest scores of the documents with enough words are drawn: a sample without replacement, weighted by likelihood ratio.

A bucket's postings are never one group: a range is dealt over salts by block, and only sums cross them. What is broadcast
is a number for each bucket. A very long text is one block: its postings are at most its features.

Null text, or none with a word: no features, weight 0, not drawn. Null doc_id: noise of the empty id, last among ties. Rows are
scored one by one, so repeated rows and ids each have a row of their own; equal score and id: by place in the table. Empty
table of documents: no rows; empty target: all t are 0. Other columns are never read.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, rows_of, save, small_batches, tidy
from .vectext import blocks

BUCKETS, MOST_WORDS = 10_000, 3
#: Ranges of buckets, and salts by which a range's postings are dealt.
RANGES, SALTS = 16, 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

POSTINGS = "part int, block long, ids array<long>, features array<long>, words array<long>, per_bucket binary, docs binary, counts binary"


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest takes, which the first byte says."""
    most = int(numbers.max(initial=0))
    size = next(k for k in (1, 2, 4, 8) if most < 1 << (8 * k))
    return bytes([size]) + numbers.astype(f"<u{size}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


@cache
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


@cache
def _zeros(k: int) -> np.ndarray:
    """What 2**k zero bytes after a text do to its crc32, as four tables, one for each byte of the crc: the map is linear."""
    if k:
        before = _zeros(k - 1)
        return np.stack([_apply(before, t) for t in before])
    one = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    return _crc_table()[one & 255] ^ (one >> 8)


def _apply(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return t[0][crc & 255] ^ t[1][(crc >> 8) & 255] ^ t[2][(crc >> 16) & 255] ^ t[3][crc >> 24]


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of texts put one after the other, from their crcs and the length of the right ones."""
    out, k = left.copy(), 0
    while (int(length.max(initial=0)) >> k) > 0:
        on = np.flatnonzero((length >> k) & 1)
        out[on] = _apply(_zeros(k), out[on])
        k += 1
    return out ^ right


def word_crcs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a run of texts: crc32, length in bytes, and the text of each."""
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    inside = _WORD[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.concatenate(([0], edge)) if inside[0] else edge
    start, length = edge[0::2], edge[1::2] - edge[0::2]
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    crc, table = np.full(len(start), 0xFFFFFFFF, np.uint32), _crc_table()
    order = np.argsort(-length, kind="stable")
    short = order[np.searchsorted(-length[order], -256) :]  # byte by byte of all words at once, but of very long ones
    s, n, c = start[short], length[short], crc[short]
    for i in range(int(n[0]) if len(n) else 0):
        on = int(np.searchsorted(-n, -i))
        c[:on] = table[(c[:on] ^ buf[s[:on] + i]) & 255] ^ (c[:on] >> 8)
    crc[short] = ~c
    raw = buf.tobytes()
    for i in order[: len(order) - len(short)].tolist():
        crc[i] = zlib.crc32(raw[start[i] : start[i] + length[i]])
    return crc, length, doc


def feature_buckets(texts: list[bytes], buckets: int = BUCKETS, most: int = MOST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of a run of texts, and the words of each text."""
    crc, length, doc = word_crcs(texts)
    space, one = np.uint32(zlib.crc32(b" ")), np.ones(1, np.int64)
    run, docs, out = crc, [doc], [crc]
    for k in range(1, min(most, len(crc))):
        begin = joined_crc(run[:-1], np.full(1, space), np.broadcast_to(one, len(run) - 1))
        run = joined_crc(begin, crc[k:], length[k:])
        same = doc[:-k] == doc[k:]
        docs.append(doc[:-k][same])
        out.append(run[same])
    return np.concatenate(docs), (np.concatenate(out) % np.uint32(buckets)).astype(np.int64), np.bincount(doc, minlength=len(texts))


def postings(rows: DataFrame, buckets: int = BUCKETS, ranges: int = RANGES) -> DataFrame:
    """(id, text) as packed postings: for each block of texts and range of buckets a row; with part -1 its ids, features and words."""
    width = -(-buckets // ranges)

    def count(frames):
        block = TaskContext.get().partitionId() << 33
        for f in frames:
            ids = [None if x is None else int(x) for x in f["id"]]
            for first, part in blocks(list(f["text"])):
                doc, bucket, words = feature_buckets(part, buckets)
                key, times = np.unique(bucket * len(part) + doc, return_counts=True)
                bucket, at = np.divmod(key, len(part))
                edge = np.searchsorted(bucket, np.arange(ranges + 1) * width)
                filled = [p for p in range(ranges) if edge[p] < edge[p + 1]]
                cut = lambda a: [None] + [_packed(a[edge[p] : edge[p + 1]]) for p in filled]  # noqa: E731, B023
                sizes = [None] + [_packed(np.bincount(bucket[edge[p] : edge[p + 1]] - p * width, minlength=width)) for p in filled]
                blank = [None] * len(filled)
                n = np.bincount(doc, minlength=len(part)).astype(np.int64)
                yield pd.DataFrame({"part": [-1, *filled], "block": block, "ids": [ids[first : first + len(part)], *blank], "features": [n, *blank], "words": [words.astype(np.int64), *blank], "per_bucket": sizes, "docs": cut(at), "counts": cut(times)})
                block += 1

    small_batches(rows.sparkSession)
    return rows.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(tidy(count), POSTINGS)  # as text: pandas would round a null's neighbours


def _by_range(packed: DataFrame, name: str, salts: int) -> DataFrame:
    """The shuffle: all postings of a range of buckets lie together, dealt over salts by block."""
    tasks = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), packed.rdd.getNumPartitions() if salts > 1 else 1)
    return save(packed.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts))).repartition(tasks, "part", "salt"), name)


def bucket_sums(packed: DataFrame, buckets: int = BUCKETS, ranges: int = RANGES) -> DataFrame:
    """(bucket, n): occurrences, summed where the postings lie before sums of salts meet."""
    width = -(-buckets // ranges)

    def add(frames):
        held = np.zeros(ranges * width, np.int64)
        for f in frames:
            for part, sizes, counts in zip(f["part"], f["per_bucket"], f["counts"], strict=True):
                upto = np.concatenate(([0], np.cumsum(_unpacked(counts))))
                edge = np.concatenate(([0], np.cumsum(_unpacked(sizes))))
                held[part * width : (part + 1) * width] += np.diff(upto[edge])
        on = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": on, "n": held[on]})

    return packed.where("part >= 0").select("part", "per_bucket", "counts").mapInPandas(tidy(add), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, ranges: int = RANGES) -> DataFrame:
    """(part, gains): the buckets of both corpora co-grouped; gains of a range in order of its buckets."""
    width = -(-buckets // ranges)
    both = bucket_sums(source, buckets, ranges).select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(bucket_sums(target, buckets, ranges).select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    each = save(source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t")).unionByName(both).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-sums", 8)
    all_ = each.agg((F.sum("s") + float(buckets)).alias("all_s"), (F.sum("t") + float(buckets)).alias("all_t"))
    gain = F.floor(1000 * F.log((F.col("t") + 1.0) * F.col("all_s") / ((F.col("s") + 1.0) * F.col("all_t"))))
    gains = each.crossJoin(F.broadcast(all_)).select((F.col("bucket") / width).cast("int").alias("part"), F.struct("bucket", gain.alias("gain")).alias("g"))  # one row beside each bucket
    return gains.groupBy("part").agg(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["gain"]).alias("gains"))  # width numbers a range


def contributions(source: DataFrame, gains: DataFrame) -> DataFrame:
    """(block, at, weight): what each range of buckets gives to each document of a block."""

    def emit(frames):
        for f in frames:
            for block, sizes, docs, counts, gain in zip(f["block"], f["per_bucket"], f["docs"], f["counts"], f["gains"], strict=True):
                sizes, doc, gain = _unpacked(sizes), _unpacked(docs), np.asarray(gain, np.int64)
                worth = np.repeat(gain, sizes[: len(gain)]) * _unpacked(counts)
                order = np.argsort(doc, kind="stable")
                doc = doc[order]
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                yield pd.DataFrame({"block": block, "at": doc[first].astype(np.int32), "weight": np.add.reduceat(worth[order], first)})

    joined = source.where("part >= 0").select("part", "block", "per_bucket", "docs", "counts").join(F.broadcast(gains), "part").drop("part")  # one number for each bucket
    return joined.mapInPandas(tidy(emit), "block long, at int, weight long")


def noise(id_: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256 of ``seed:id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, ranges: int = RANGES) -> DataFrame:
    """(block, at, id, n_features, n_words, weight) of every row; block and at tell rows apart."""
    source = _by_range(postings(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")), buckets, ranges), "postings", SALTS)
    wanted = _by_range(postings(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), buckets, ranges), "target-postings", SALTS)
    gains = bucket_gains(source, wanted, buckets, ranges)
    own = source.where("part < 0").select("block", F.posexplode(F.arrays_zip("ids", "features", "words")).alias("at", "d")).select("block", "at", F.lit(0).cast("long").alias("weight"), F.col("d.ids").alias("id"), F.col("d.features").alias("n_features"), F.col("d.words").alias("n_words"))
    rows = own.unionByName(contributions(source, gains), allowMissingColumns=True)
    return rows.groupBy("block", "at").agg(F.max("id").alias("id"), F.max("n_features").alias("n_features"), F.max("n_words").alias("n_words"), F.sum("weight").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, num: int = 5, den: int = 100, least_words: int = 20, seed: str = "42", id_column: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """id, n_features, weight, score, rank of every row: the floor(num * N / den) highest scores of the N rows with enough words have a rank."""
    all_ = weigh(docs, target, id_column, text, target_text).withColumn("score", (F.col("weight") + noise(F.col("id"), seed)).cast("long"))
    all_ = save(all_, "scores")
    may = ranked(all_.where(F.col("n_words") >= least_words), [F.desc("score"), F.asc_nulls_last("id"), F.asc("block"), F.asc("at")])
    drawn = rows_of(may) * num // den if rows_of(may) else 0
    out = may.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = all_.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = out.select(*rest.columns).unionByName(rest)
    return out.select(F.col("id").alias(id_column), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
