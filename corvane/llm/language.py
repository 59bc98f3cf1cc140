"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: slot i holds bit i of every language's filter as one word, so k probes and
an AND return the set of all languages that contain an n-gram. Counting those bits over a text gives each language's
hits; the hits that chance alone brings (the filter's fill to the power k) are taken out; the most hits decide.

An n-gram enters a language's filter if its rate there is at least ``share`` of its highest rate in any language, so
the sets returned are small. The filters are learned from at most ``SAMPLE_DOCS`` different texts a language, all languages
and all n-grams of these that occur ``least`` times; the executors set the bits, and only the filled slots are fetched.

Null text, or text without a letter: ``und``, score 0. Very long text: read whole, alone. Ties: the first language in
alphabetical order. Repeated rows: each is judged; in learning a text counts once a language. No labelled row at all: every
text is ``und``. Empty table: empty result. Columns: those asked for pass through, whatever their names; what is predicted
takes the names given, before a column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import free_name, save, small_batches, tidy
from .vectext import mix

#: Texts a language from which the filters are learned, chosen by hash (the bound of the classifier's sample).
SAMPLE_DOCS = 3_000
UNKNOWN = "und"
#: Files of what the bounded sample gives.
FILES = 8
#: Languages to a word of bits.
WORD = 64
_CHARS = 200_000

_letters: list[np.ndarray] = []


def _is_letter(code: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0][code]


def grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased letters (other runs: one space), each one's text, and if a text has a letter."""
    lowered = [t.lower() for t in texts]
    joined = "".join(f"\n{t}\n\n\n" for t in lowered)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 4 for t in lowered])
    letter = _is_letter(code)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters stays, as a space
    has = np.bincount(doc[letter], minlength=len(texts)) > 0
    code, doc = np.where(letter, code, 32)[keep].astype(np.uint64), doc[keep]
    h = np.zeros(max(0, len(code) - n + 1), np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + code[i : i + len(h)]
    same = doc[: len(h)] == doc[n - 1 :] if len(h) else np.zeros(0, bool)
    return mix(h[same]), doc[: len(h)][same], has


def _runs(texts: list, most: int = _CHARS):
    """Runs of texts of at most ``most`` characters or one text; as (place of the first, texts with null as empty)."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if held and size + len(t) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


@dataclass
class Filters:
    """languages: by bit; slots: arrays of language bits, one for each 64 languages; probes: hash functions; chance: of a false hit."""

    languages: list[str]
    slots: list[np.ndarray]
    probes: int
    chance: np.ndarray
    n: int

    def masks(self, h: np.ndarray, word: int = 0) -> np.ndarray:
        """The languages, as bits, whose filters contain each n-gram; word: of which 64 languages."""
        slots = self.slots[word]
        top = np.uint64(len(slots) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        found = slots[(h & top).astype(np.int64)]
        for i in range(1, self.probes):
            found = found & slots[((h + np.uint64(i) * step) & top).astype(np.int64)]
        return found

    def judge(self, texts: list) -> tuple[list[str], np.ndarray]:
        langs, scores = [], []
        for _, part in _runs(texts):
            h, doc, has = grams(part, self.n)
            total = np.bincount(doc, minlength=len(part)).astype(float)
            top, best = np.zeros(len(part)), np.zeros(len(part), int)
            for i in range(len(self.languages)):
                if i % WORD == 0:
                    mask = self.masks(h, i // WORD)
                    kind = mask.dtype.type
                hits = np.bincount(doc, weights=(mask >> kind(i % WORD)) & kind(1), minlength=len(part))
                hits = np.maximum(hits - total * self.chance[i], 0) / max(1 - self.chance[i], 1e-9)
                best[hits > top] = i
                top = np.maximum(top, hits)
            score = np.where(has, np.minimum(top / np.maximum(total, 1), 1), 0)
            langs += [self.languages[b] if ok and self.languages else UNKNOWN for b, ok in zip(best, has, strict=True)]
            scores.append(score)
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", n: int = 4, share: float = 0.2, least: int = 3, probes: int = 3) -> Filters:
    """Learn the filters from labelled rows; those without text or language are left out."""
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    texts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row for each language
    languages = sorted(texts)
    if not languages:
        return Filters([], [], probes, np.zeros(0), n)
    of = F.broadcast(spark.createDataFrame([(k, i, min(1.0, 1.3 * SAMPLE_DOCS / texts[k])) for i, k in enumerate(languages)], "lang string, bit int, cut double"))
    rows = rows.join(of, "lang").where((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < F.col("cut")).dropDuplicates(["lang", "h"])
    sample = rows.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= SAMPLE_DOCS)

    def count(frames):
        held: dict[int, list] = {}
        for f in frames:
            for k, g in f.groupby("bit"):
                for _, part in _runs(list(g["text"])):
                    held.setdefault(k, []).append(np.unique(grams(part, n)[0], return_counts=True))
        for k, parts in held.items():
            h, i = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            c = np.bincount(i, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pd.DataFrame({"bit": k, "gram": h.view(np.int64), "c": c})

    got = sample.select("bit", "text").mapInPandas(tidy(count), "bit int, gram long, c long").groupBy("bit", "gram").agg(F.sum("c").alias("c"))
    got = save(got.where(F.col("c") >= least), "grams", FILES)
    total = got.groupBy("bit").agg(F.sum("c").alias("total"))
    rate = got.join(F.broadcast(total), "bit").select("bit", "gram", (F.col("c") / F.col("total")).alias("rate"))
    member = rate.withColumn("most", F.max("rate").over(W.partitionBy("gram"))).where(F.col("rate") >= share * F.col("most")).select("bit", "gram")
    member = save(member, "members", FILES)
    # Slots: about ten for each n-gram of the largest language, so that few are false.
    largest = member.groupBy("bit").count().agg(F.max("count")).first()[0] or 1
    size = 1 << max(12, int(10 * largest).bit_length())
    low = lambda c: c.bitwiseAND(F.lit(size - 1))
    step = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
    slot = F.explode(F.array(*[low(low(F.col("gram")) + j * low(step)) for j in range(probes)])).alias("slot")
    bits = member.select((F.col("bit") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, bit % {WORD})").alias("mask"), slot).groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
    slots = [np.zeros(size, kind) for _ in range(-(-len(languages) // WORD))]
    for word, part in bits.groupby("word"):
        slots[word][part["slot"].to_numpy()] = part["mask"].to_numpy().view(np.uint64).astype(kind)
    chance = [float(((slots[i // WORD] >> kind(i % WORD)) & kind(1)).mean()) ** probes for i in range(len(languages))]
    return Filters(languages, slots, probes, np.array(chance), n)


def predict(docs: DataFrame, filters: Filters, keep: list[str], text: str = "text", out_lang: str = "lang_pred", out_score: str = "score") -> DataFrame:
    """Columns ``keep`` with each text's language and score: the share of its n-grams that its language's filter holds."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(filters)  # ten slots for each n-gram of the largest bounded sample
    keep = [c for c in keep if c.lower() not in (out_lang.lower(), out_score.lower())]
    held = free_name("__text", keep)
    schema = docs.select(*keep).schema.add(out_lang, "string").add(out_score, "double")

    def judge(frames):
        model = shared.value
        for f in frames:
            langs, scores = model.judge(list(f[held]))
            out = f.drop(columns=held)
            out[out_lang], out[out_score] = langs, scores
            yield out

    return docs.select(*keep, F.col(text).alias(held)).mapInPandas(tidy(judge), schema)
