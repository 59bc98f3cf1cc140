"""Minimax contiguous partition of ordered atomic groups into shards.

Groups (equal texts) stand in the order of a 64-bit hash. The smallest capacity that holds them in k contiguous runs is
found by binary search; a capacity is feasible if cutting greedily, as late as it allows, needs at most k runs. The
groups themselves never reach the driver: it sees sums over hash ranges. A range that a cut could fall into is split
into finer ranges until it holds one group, which bounds what is fetched and still gives the exact optimum.

Null text: as empty, with no bytes. Very long text: one size among others; its own bytes bound the capacity from below. Empty
table: empty result. Copies: one group, so they share a shard, whatever their ids. Repeated rows, and rows with a null or
repeated id, each get a slot; ties in order are broken by doc_id. Other columns: never read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import save

#: Hash ranges on each level: 2 to this power; also what one fetch may bring for each range that is split.
BITS = 12
#: Ranges split in one round, the largest first; the rest waits for a later round, by which it may no longer matter.
MOST_SPLIT = 64


def greedy(sizes: np.ndarray, capacity: int, k: int) -> np.ndarray | None:
    """First place of each run after the first if every run holds at most ``capacity``; None if k runs do not do."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    cuts, at = [], 0
    for _ in range(k):
        at = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        if at >= len(sizes):
            return np.array(cuts + [len(sizes)] * (k - 1 - len(cuts)), dtype=np.int64)
        cuts.append(at)
    return None


def smallest(sizes: np.ndarray, k: int) -> int:
    """The least capacity with which ``greedy`` needs at most k runs."""
    lo, hi = int(max(sizes.max(initial=0), -(-sizes.sum() // k))), int(sizes.sum())
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(sizes, mid, k) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def loosest(total: np.ndarray, whole: np.ndarray, largest: int, k: int) -> int:
    """A lower bound of the capacity: as if ranges of several groups could be cut at any byte (whole: those of one)."""
    end = int(total[-1])

    def enough(capacity: int) -> bool:
        at = 0
        for _ in range(k):
            at += capacity
            if at >= end:
                return True
            i = int(np.searchsorted(total, at, side="right")) - 1
            at = int(total[i]) if whole[i] else at
        return False

    lo, hi = max(largest, -(-end // k)), end
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if enough(mid) else (mid + 1, hi)
    return lo


def cut_keys(groups: DataFrame, k: int) -> list[int]:
    """The first key of each run after the first, of the minimax partition of groups (key long >= 0, size) into k runs.

    Each round fetches sums over ranges of keys; only ranges where a cut may fall, for any capacity between the lower
    bound and the best found, are split further. A last run may be empty: its key is then past all keys.
    """
    # ranges: rows (first key, width in bits, size, groups, largest group), in order, covering all keys
    def fetch(spans: list[tuple[int, int]]) -> list[tuple]:
        parts = []
        for width in sorted({w for _, w in spans}):
            finer = max(0, width - BITS)
            own = [lo for lo, w in spans if w == width]
            g = groups if width >= 63 else groups.where(F.shiftright("key", width).isin([lo >> width for lo in own]))
            g = g.groupBy(F.shiftright("key", finer).alias("r")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m"))
            parts += [(r["r"] << finer, finer, r["s"], r["n"], r["m"]) for r in g.collect()]  # at most 2**BITS for each span
        return sorted(parts)

    ranges = fetch([(0, 63)])
    while ranges:
        sizes, largest = np.array([r[2] for r in ranges], dtype=np.int64), np.array([r[4] for r in ranges], dtype=np.int64)
        whole = np.array([r[3] == 1 or r[1] == 0 for r in ranges])
        total = np.concatenate(([0], np.cumsum(sizes)))
        end = int(total[-1])
        high, low = smallest(sizes, k), loosest(total, whole, int(largest.max()), k)
        open_: set[int] = set()
        early = late = 0  # bytes before the cut, as early and as late as it can fall
        for _ in range(k - 1):
            early, late = min(early + low, end), min(late + high, end)
            a, b = (min(int(np.searchsorted(total, x, side="right")) - 1, len(ranges) - 1) for x in (early, late))
            if early < end:
                early = max(int(total[a]), early - int(largest[a]))
            if late < end and whole[b]:
                late = int(total[b])
            open_.update(i for i in range(a, b + 1) if not whole[i])
        if not open_:
            return [ranges[c][0] if c < len(ranges) else 1 << 63 for c in greedy(sizes, high, k)]
        open_ = set(sorted(open_, key=lambda i: -sizes[i])[:MOST_SPLIT])
        split = fetch([(ranges[i][0], ranges[i][1]) for i in sorted(open_)])
        ranges = sorted([r for i, r in enumerate(ranges) if i not in open_] + split)
    return [1 << 63] * (k - 1)


def shard(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, size, text_crc32, shard and slot (gapless in each shard) of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(t).bitwiseAND(F.lit((1 << 63) - 1)).alias("key"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    rows = save(rows, "sizes")
    groups = save(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    cuts = cut_keys(groups, shards)
    number = F.lit(0)
    for c in cuts:
        if c < 1 << 63:
            number = number + (F.col("key") >= F.lit(c)).cast("int")
    rows = rows.withColumn("shard", number)
    # Slots without one task for a shard: rows are dealt over salts, whose counts give where each salt's slots begin.
    salts = max(1, -(-rows.count() // 20_000))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(salts)))
    begins = rows.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    begins = begins.withColumn("begin", F.sum("n").over(W.partitionBy("shard").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))).drop("n")
    rows = rows.withColumn("local", F.row_number().over(W.partitionBy("shard", "salt").orderBy("doc_id", "key")))
    rows = rows.join(begins, ["shard", "salt"])
    return rows.select("doc_id", "key", "size", "text_crc32", "shard", (F.coalesce("begin", F.lit(0)) + F.col("local") - 1).cast("long").alias("slot"))
