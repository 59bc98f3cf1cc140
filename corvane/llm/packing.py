"""Packing of token sequences: cutting-stock column generation over a length histogram.

A document is cut at multiples of the capacity; what is left of it goes whole into one sequence. Only a histogram of
those lengths (at most ``capacity`` counts, whatever the corpus) reaches the driver. There a linear program over
patterns (multisets of length classes that fit) is solved by column generation: the basis gives a price to each class,
an unbounded-knapsack dynamic program finds the pattern worth most at these prices, and it enters until none is worth
more than a sequence. Patterns are used as often as the rounded-down solution says; the few pieces that remain are
packed best fit. Documents, ranked inside their length class, then take the places that the patterns open, by range.

Nulls: a null text is empty, its ids are the end id alone. Empty table: empty result. Repeated rows: each row is packed,
rows with the same or a null doc_id too. Very long text: encoded alone, whole, and cut into as many pieces as it takes.
Ties in length are ranked by doc_id, then place and ids; what ties then is alike. Other columns: never read, whatever their
names. The string of a special token in a text gives that token's id, as the tokenizer does by default.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import save, small_batches, tidy

#: Words whose ids a task keeps (about 200 bytes each); the cache starts anew when it is full, so it is bounded.
CACHE_WORDS = 500_000

#: Pieces that one task ranks at a time: at least so many; and so many runs of them at most, beside one for each class.
LEAST_RUN, MOST_RUNS = 250, 50_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

_encoders: dict = {}

#: White-space-free runs that are one word of Latin letters, with a point or comma at most.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)")
#: str.split cuts at these, but they are no white space to a tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
_PROBE = ["the", "Zürich", "façade,", "ÉTÉ.", "re", "s", "nation's", "a.b", "größe", "ÿ,", "x", "Ll", "d."]


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable ones as themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Ids of texts by a tokenizer that drops white space: the ids of each white-space-free run are kept, as bytes.

    The tokenizer's first cut is at white space, so a text's ids are those of its runs. A run of plain letters goes to
    the vocabulary's merges at once (lower-cased, as byte letters); every other run takes the whole way. Whether the
    short way holds for a tokenizer is tried on a few words first.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A special token that holds white space could lie across runs: then texts are encoded as they are.
        self.by_runs = not any(re.search(r"\s", t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.model, self.letters, self.tails = self.tokenizer.model, _byte_letters(), {"": []}
        self.short = False
        self.tails |= {c: self._whole(c) for c in ".,"}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.short = not any(map(str.isalpha, special)) and all(self._short(w) in (None, self._whole(w)) for w in _PROBE)

    def _whole(self, run: str) -> list[int]:
        return self.tokenizer.encode(run, add_special_tokens=False).ids

    def _short(self, run: str) -> list[int] | None:
        m = _PLAIN.fullmatch(run)
        if m is None:
            return None
        word = m[1].lower().encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(word)] + self.tails[m[2]]

    def __missing__(self, run: str) -> bytes:
        ids = (self._short(run) if self.short else None) or self._whole(run)
        self[run] = out = np.array(ids, self.kind).tobytes()
        return out

    def encode(self, text: str) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        if not self.by_runs or _ODD.search(text):
            return np.array(self._whole(text), "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), self.kind).astype("<u4")


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Each document's pieces: cut at multiples of the capacity. The texts are read once and never shuffled."""

    def cut(frames):
        encode = encoder(tokenizer).encode
        end = np.array([end_id], "<u4")
        for f in frames:
            rows = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                a = np.concatenate((encode(text), end)) if isinstance(text, str) else end
                n = len(a)
                d = None if pd.isna(doc) else int(doc)
                for s in range(0, n, capacity):
                    part = a[s : s + capacity]
                    rows.append((d, s, len(part), zlib.crc32(part), n))
            yield pd.DataFrame({c: pd.array([r[i] for r in rows], dtype="Int64") for i, c in enumerate(("doc_id", "start", "length", "ids_crc32", "doc_tokens"))})
        encoder(tokenizer).clear()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tidy(cut), PIECES)


def knapsack(prices: np.ndarray, weights: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of classes that is worth most and fits: value and counts. Dynamic program over the room."""
    best = np.zeros(room + 1)
    take = np.full(room + 1, -1)
    order = np.argsort(weights, kind="stable")
    w, p = weights[order], prices[order]
    upto = np.searchsorted(w, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        n = upto[c]
        if n:
            v = best[c - w[:n]] + p[:n]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], take[c] = v[i], order[i]
    counts, c = np.zeros(len(weights), dtype=np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= weights[take[c]]
    return float(best[room]), counts


def inverted(a: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan with row pivots; few rows, and no thread pool of a linear algebra library is woken."""
    n = len(a)
    m = np.hstack((a.astype(float), np.eye(n)))
    for i in range(n):
        p = i + int(np.abs(m[i:, i]).argmax())
        if p != i:
            m[[i, p]] = m[[p, i]]
        m[i] /= m[i, i]
        rest = m[:, i].copy()
        rest[i] = 0
        m -= rest[:, None] * m[i]
    return m[:, n:]


def column_generation(demand: np.ndarray, weights: np.ndarray, room: int, gap: float = 1e-3, most: int = 3000, smooth: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Fractional cutting stock: least number of sequences that hold ``demand`` pieces of each class.

    Revised simplex over an explicit basis inverse, priced at a blend with the prices of the best lower bound so far.
    Ends when no pattern improves, or when that bound shows the value within ``gap`` of the optimum. Returns patterns (rows) and their use.
    """
    fill = np.maximum(room // weights, 1)
    basis = np.diag(fill.astype(float))
    inverse = np.diag(1.0 / fill)
    use = demand / fill
    bound, center = 0.0, inverse.sum(axis=0)
    for step in range(most):
        prices = inverse.sum(axis=0)
        blend = smooth * center + (1 - smooth) * prices  # smoothed prices: far fewer steps than the basis's own
        value, pattern = knapsack(blend, weights, room)
        if (low := float((blend * demand).sum()) / max(value, 1.0)) > bound:
            bound, center = low, blend / max(value, 1.0)
        if use.sum() - bound < gap * use.sum():
            break
        if (prices * pattern).sum() <= 1 + 1e-9:
            value, pattern = knapsack(prices, weights, room)
            if value <= 1 + 1e-9:
                break
        direction = (inverse * pattern).sum(axis=1)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, use / np.where(up, direction, 1), np.inf)
        out = int(ratio.argmin())
        theta = max(ratio[out], 0.0)
        use = use - theta * direction
        use[out] = theta
        basis[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse = inverse - direction[:, None] * row
        inverse[out] = row
        if step % 200 == 199:
            inverse = inverted(basis)
            use = np.maximum((inverse * demand).sum(axis=1), 0)
    return basis.T.astype(np.int64), np.maximum(use, 0)


def best_fit(left: np.ndarray, weights: np.ndarray, room: int) -> list[np.ndarray]:
    """Pack the pieces that rounding left, longest first, each into the fullest sequence that still takes it."""
    made: list[np.ndarray] = []
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    for i in np.argsort(-weights, kind="stable"):
        for _ in range(int(left[i])):
            w = int(weights[i])
            at = next((r for r in range(w, room + 1) if by_room[r]), None)
            if at is None:
                made.append(np.zeros(len(weights), dtype=np.int64))
                k, at = len(made) - 1, room
            else:
                k = by_room[at].pop()
            made[k][i] += 1
            by_room[at - w].append(k)
    return made


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, grain: int) -> list[tuple[int, int, int, int, int]]:
    """Places for ranked pieces: rows (class, first rank, past last rank, first sequence, pieces of the class in each).

    lengths, counts: the histogram; a class is the lengths that round up to the same multiple of ``grain``.
    """
    classes = -(-lengths // grain)
    kinds = np.unique(classes)
    demand = np.array([counts[classes == k].sum() for k in kinds], dtype=np.int64)
    room = capacity // grain
    if not len(kinds):
        return []
    patterns, use = column_generation(demand.astype(float), kinds, room)
    times = np.floor(use + 1e-9).astype(np.int64)
    left = demand - times @ patterns
    for i in np.flatnonzero(left < 0):  # an overfull class: take patterns back, one at a time
        for p in np.argsort(-patterns[:, i]):
            while left[i] < 0 and times[p] > 0 and patterns[p, i]:
                times[p] -= 1
                left += patterns[p]
    used = [(patterns[p], int(times[p])) for p in range(len(patterns)) if times[p]]
    used += [(p, 1) for p in best_fit(left, kinds, room)]
    places, sequence, taken = [], 0, np.zeros(len(kinds), dtype=np.int64)
    for pattern, n in used:
        for i in np.flatnonzero(pattern):
            a = int(pattern[i])
            places.append((int(kinds[i]), int(taken[i]), int(taken[i] + a * n), sequence, a))
            taken[i] += a * n
        sequence += n
    return places


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, grain: int = 16) -> DataFrame:
    """Pieces with sequence_id and offset; every id lies in one piece, no sequence holds more than ``capacity``.

    grain: lengths are rounded up to it in the plan, so a piece wastes less than ``grain`` places at most.
    """
    if capacity % grain:
        raise ValueError("capacity must be a multiple of grain")
    pieces = save(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    classed = pieces.withColumn("class", F.expr(f"(length + {grain - 1}) div {grain}"))
    histogram = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    rows = sum(r["count"] for r in histogram)
    lengths = np.array([r["length"] for r in histogram], dtype=np.int64)
    counts = np.array([r["count"] for r in histogram], dtype=np.int64)
    places = plan(lengths, counts, capacity, grain)
    # Ranks in a class without one task for it: a class is dealt over salts, by its own count; theirs give where each begins.
    held: dict[int, int] = {}
    for length, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        held[-(-length // grain)] = held.get(-(-length // grain), 0) + n
    run = max(LEAST_RUN, rows // MOST_RUNS)
    salts = F.create_map(*[F.lit(x).cast("long") for k, n in held.items() for x in (k, -(-n // run))]) if held else F.create_map(F.lit(0).cast("long"), F.lit(1).cast("long"))
    classed = classed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), salts[F.col("class")]))
    begins = classed.groupBy("class", "salt").agg(F.count("*").alias("n"))
    begins = begins.withColumn("begin", F.sum("n").over(W.partitionBy("class").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)))
    local = F.row_number().over(W.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = classed.withColumn("local", local).join(begins.drop("n"), ["class", "salt"])
    ranked = ranked.withColumn("rank", F.col("local") - 1 + F.coalesce("begin", F.lit(0)))

    spark = docs.sparkSession
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("class", "lo", "hi", "base", "each")])
    plan_rows = spark.createDataFrame(places, schema)  # patterns times their classes: bounded by the histogram
    placed = ranked.join(F.broadcast(plan_rows), "class").where("rank >= lo and rank < hi")
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - lo) div each"))
    before = W.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(W.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
