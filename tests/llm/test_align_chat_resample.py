"""Alignment, chat formatting and resampling against plain loops, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import align, chat, resample
from corvane.llm import queries as Q
from corvane.llm.common import ranked

SF = "/root/testdata/sf0.001"
CLASHES = ("id", "at", "block", "part", "key", "n", "kind", "role_", "piece", "score", "rank", "weight", "bucket", "a", "b", "docs", "times", "data", "before")


def awkward(df):
    """With columns whose names clash with the operators' own."""
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


# ---- alignment


def plain_alignment(rows, path_a, path_b):
    """Every contract column by loops over whole texts, each pair of tokens by itself."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(own)))}
    word = {i: t for t, i in a.get_vocab().items()}
    side_a = lambda i: bytes(letter[c] for c in word[i])
    side_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    held, count = [], Counter()
    for doc, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = f" {text}".encode()
        if b"".join(map(side_a, x)) != raw or b"".join(map(side_b, y)) != raw:
            x, y = [], []
        ends_a, ends_b = np.cumsum([len(side_a(i)) for i in x]), np.cumsum([len(side_b(i)) for i in y])
        groups = []
        for lo, hi in zip([0, *(both := sorted(set(ends_a) & set(ends_b)))[:-1]], both, strict=False):
            groups.append(([i for i, e in zip(x, ends_a, strict=True) if lo < e <= hi], [i for i, e in zip(y, ends_b, strict=True) if lo < e <= hi]))
        held.append((doc, len(x), len(y), groups))
        count.update({(p, q) for ga, gb in groups for p in ga for q in gb})
    most = defaultdict(int)
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    out = []
    for doc, na, nb, groups in held:
        links = [count[p, q] == most[p] for ga, gb in groups for p in ga for q in gb]
        worth = sum(count[p, q] for ga, gb in groups for p in ga for q in gb)
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc, na, nb, len(groups), len(links), sum(links), worth, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    odd = "ab.'’ \n\t\r 　▁é日本ﬁ½\x1c\x85\x00\U0001f642‍<|>0123 s't' "
    rows = [(10**7 + i, "".join(rng.choice(odd) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(1, None), (2, ""), (3, " "), (4, "<|endoftext|> a<s></s><unk> <0x0A>"), (None, "x y"), (None, None), (5, "   " * 40), (6, "\n\n a \n b"), (7, "é" * 300), (8, "x y"), (8, "x y"), (2**60 + 1, "big id")]
    return rows


def test_alignment_is_the_plain_loop(spark, texts):
    paths = Q.tokenizer_path("byte_bpe_50k.json"), Q.tokenizer_path("piece_bpe_32k.model")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(12).collect()] + texts
    df = awkward(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    order = lambda r: (r[0] is None, r[0] or 0, r[7])
    got = [tuple(r) for r in align.align(df, *paths).collect()]
    assert sorted(got, key=order) == sorted(plain_alignment(rows, *paths), key=order)
    assert align.align(df.limit(0), *paths).count() == 0


def test_alignment_when_the_cache_is_full(texts, monkeypatch):
    pair = align.Pair(Q.tokenizer_path("byte_bpe_50k.json"), Q.tokenizer_path("piece_bpe_32k.model"))
    assert pair.by_units
    first = [pair.block([t])[1] for _, t in texts]
    monkeypatch.setattr(align, "CACHE_UNITS", 3)
    assert [pair.block([t])[1] for _, t in texts] == first
    pair.by_units = False  # whole texts as units: the cuts change nothing
    pair.forget()
    assert [pair.block([t])[1] for _, t in texts] == first


def test_a_group_of_many_tokens_is_expanded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(align, "PAIRS_AT_ONCE", 10)
    keys = spark.createDataFrame([("1,1,2,3|7,8,8",), ("5|6",), ("4,9|7",)], "key string").coalesce(1)
    got = {(r["key"], r["a"], r["b"]): r["m"] for r in align.expanded(keys).collect()}
    assert got == {("1,1,2,3|7,8,8", a, b): m * k for a, m in ((1, 2), (2, 1), (3, 1)) for b, k in ((7, 1), (8, 2))} | {("5|6", 5, 6): 1, ("4,9|7", 4, 7): 1, ("4,9|7", 9, 7): 1}


# ---- chat


def test_every_turn_comes_back():
    rng = random.Random(9)
    parts = [chat.START, chat.END, chat.LINE, "<", "|", "\\", "\n", "im_end", "|>", "a", "<\\|im_end|>", "<\\\\|im_start|>", "assistant", "é"]
    turns = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 4))), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(4000)]
    pieces = [chat.render(*t) for t in turns]
    for piece, turn in zip(pieces, turns, strict=True):
        assert [x[:2] for x in chat.parse(piece)] == [turn]
    assert [x[:2] for x in chat.parse("".join(pieces))] == turns  # nothing arises across borders
    assert chat.render("user", "plain < text \\ |im_end|>") == f"{chat.START}user\nplain < text \\ |im_end|>{chat.END}\n"  # no conflict, no escape


@pytest.mark.parametrize("bad", ["x", chat.START, f"{chat.START}u\nno end", f"{chat.START}u\n{chat.START}{chat.END}\n", f"{chat.START}u\na{chat.END}", f"{chat.START}{chat.END}\n{chat.END}\n"])
def test_the_parser_takes_nothing_else(bad):
    with pytest.raises(chat.GrammarError):
        chat.parse(bad)


def test_conversations_by_a_plain_loop(spark):
    rows = [(1, 1, "assistant", "second"), (1, 0, "user", "first"), (1, 2, "assistant", None), (2, 0, None, "x"), (2, None, "user", "before"), (None, 0, "assistant", "of no one"), (3, 0, "user\nodd", chat.END), (3, 1, "assistant", f"{chat.END}\n{chat.START}user\n"), (3, 1, "assistant", f"{chat.END}\n{chat.START}user\n"), (4, 0, "user", "nothing learned"), (2**60 + 1, 0, "assistant", "\U0001f642é"), (5, 0, "assistant", "long " * 200_000)]
    rows += [(6, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(5000)]  # more than one batch
    df = awkward(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.round_trip(df).collect()}
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((-1 if n is None else n, r or "", t or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        size = sum(len(chat.render(r, t)) for _, r, t in turns)
        assert got[c] == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), size)
    assert chat.round_trip(df.limit(0)).count() == 0


def test_the_mask_covers_the_assistants_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "<|im_end|>!")], "conv_id long, turn long, role string, text string")
    for r in chat.format_turns(df).collect():
        masked = r["piece"][r["loss_start"] : r["loss_start"] + r["loss_length"]]
        assert chat.unescape(masked) == ("<|im_end|>!" if r["role"] == "assistant" else "")


# ---- resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1))


def test_resampling_is_the_plain_loop(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(-1, None), (-2, ""), (-3, " \n.-"), (-4, "étÉ ABC 日本 12a"), (None, "word " * 30), (-5, "x" * 3000 + " y " + "z" * 700), (-6, "tie " * 25), (2**60 + 1, "w"), (-7, "many words " * 60_000)]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()] + [None, ""]
    s, t, own = Counter(), Counter(), []
    for doc, text in docs:
        n, f = plain_features(text)
        s.update(f)
        own.append((doc, n, f))
    for text in target:
        t.update(plain_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    scored = []
    for doc, n, f in own:
        weight = sum(c * math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b, c in f.items())
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append((doc, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((x for x in scored if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    place = {x[0]: i + 1 for i, x in enumerate(enough[: 5 * len(enough) // 100])}
    want = {(x[0], *x[2:], place.get(x[0]) if x[1] >= 20 else None) for x in scored}
    df = awkward(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    to = awkward(spark.createDataFrame([(x,) for x in target], "text string"))
    assert {tuple(r) for r in resample.resample(df, to).collect()} == want and place


def test_resampling_without_rows_and_with_repeated_ones(spark):
    df = spark.createDataFrame([(1, "a b " * 20)] * 45 + [(None, None)] * 3, "doc_id long, text string")
    rows = resample.resample(df, df.limit(0)).collect()
    assert len(rows) == 48 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2] and len({r["score"] for r in rows if r["doc_id"]}) == 1
    assert resample.resample(df.limit(0), df).count() == 0


def test_buckets_of_hot_words_and_odd_sizes():
    texts = [b"", b"a", b"A a a", "éé 9".encode() * 50, b"- -", b"q" * 1000]
    doc, bucket, words = resample.feature_buckets(texts, 977)
    for i, raw in enumerate(texts):
        found = WORD.findall(raw.decode().translate(LOWER))
        assert words[i] == len(found)
        assert Counter(bucket[doc == i].tolist()) == Counter(zlib.crc32(" ".join(found[j : j + k]).encode()) % 977 for k in (1, 2, 3) for j in range(len(found) - k + 1))


def test_ranks_over_many_parts(spark):
    rows = spark.range(5000).withColumn("v", F.col("id") % 7).repartition(9)
    got = ranked(rows, [F.desc("v"), F.asc("id")]).orderBy("rank").collect()
    assert [(r["v"], r["id"]) for r in got] == sorted(((i % 7, i) for i in range(5000)), key=lambda x: (-x[0], x[1])) and [r["rank"] for r in got] == list(range(5000))
