"""The llm operators against brute force, exact round trips and held-out accuracy, and on awkward input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm import decontam, language, lines, media, neardup, packing, quality, sharding, urls, warc
from corvane.llm import queries as Q
from corvane.llm.common import save

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "  \n\t ", "en", "s"), (4, "12 345", None, "s"), (5, "the cat sat on the mat " * 9000, "en", "s"), (6, "a", "en", "s"), (7, "same text here for all", "en", "s"), (8, "same text here for all", "en", "s"), (8, "same text here for all", "en", "s"), (None, "der Hund und die Katze", "de", None)]
    df = spark.createDataFrame([(a, b, c, d, 1) for a, b, c, d in rows], DOCS)
    for c in ("id", "a", "b", "h", "key", "words", "start", "end", "hash", "component", "score", "length", "slot", "salt", "class", "w", "t"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_awkward_and_empty(spark, odd):
    items = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "dog and")], "item_id long, text string")
    filters = language.learn(odd)
    model = quality.train(odd, odd.select("doc_id", F.lit(1).alias("quality")))
    for d, n in ((odd, 10), (odd.limit(0), 0)):
        assert language.predict(d, filters, ["doc_id"]).count() == n
        assert quality.score(d, model, ["doc_id"]).count() == n
        assert sharding.shard(d).count() == n
        assert media.digest(d).count() == n
        assert lines.dedup_lines(d).count() == n
        assert neardup.near_duplicates(d).count() == n
        assert decontam.decontaminate(d, items).count() == n
        assert packing.pack(d, Q.tokenizer_path()).where("start = 0").count() == n
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(odd, filters, ["doc_id"]).collect()}[4] == "und"
    found = {r["doc_id"]: r["item_ids"] for r in decontam.decontaminate(odd, items).collect()}
    assert found[5] == [1] and found[7] == []
    near = {r["doc_id"]: r for r in neardup.near_duplicates(odd).collect()}
    assert near[8]["component_id"] == 7 and near[1]["n_shingles"] == 0 and near[6]["n_shingles"] == 1


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    more = [(10**6, "foo <|endoftext|> bar"), (10**6 + 1, "a<|startoftext|>b<|endoftext|> c"), (10**6 + 2, "<|ENDOFTEXT|>"), (10**6 + 3, "  ")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    ids = {r["doc_id"]: [*t.encode(r["text"], add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = packing.pack(docs, Q.tokenizer_path()).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r["ids_crc32"] and len(ids[r["doc_id"]]) == r["doc_tokens"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held, total in [(v, len(ids[k])) for k, v in by_doc.items()] + [(v, None) for v in by_seq.values()]:
        at = 0
        for s, n in sorted(held):
            assert s == at
            at += n
        assert at == total if total is not None else at <= 2048
    assert by_doc.keys() == ids.keys()
    assert sum(map(len, ids.values())) / (2048 * len(by_seq)) > 0.93


def test_column_generation_reaches_the_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    w = np.arange(1, 33)
    d = rng.integers(1, 50, 32).astype(float)
    patterns, use = packing.column_generation(d, w, 32)
    assert (patterns @ w <= 32).all() and np.allclose(patterns.T @ use, d) and d @ w / 32 <= use.sum() + 1e-9 <= len(packing.best_fit(d, w, 32)) + 1e-9


def test_language(spark):
    out = Q.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[1] > 100 and held[0] > 0.95


def _naive_grams(t, n=4):
    """n-grams of lower-cased letters, other runs being one space."""
    t = re.sub(r"[^\W\d_]+|[\W\d_]+", lambda m: m[0] if m[0][0].isalpha() else " ", t.lower())
    t = t[1:] if t.startswith(" ") else t
    return [t[i : i + n] for i in range(len(t) - n + 1)]


def test_language_against_counts(spark, docs):
    rows = [r for r in docs.collect() if len(r["text"]) < 5000]
    counts = {}
    for k in {r["lang"] for r in rows}:
        c = Counter(g for t in {r["text"] for r in rows if r["lang"] == k} for g in _naive_grams(t))
        counts[k] = {g: x for g, x in c.items() if x >= 3}
    rate = {k: {g: x / sum(c.values()) for g, x in c.items()} for k, c in counts.items()}
    most = {g: max(r.get(g, 0) for r in rate.values()) for c in counts.values() for g in c}
    member = {k: {g for g, x in r.items() if x >= 0.2 * most[g]} for k, r in rate.items()}
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.predict(df, language.learn(df), ["doc_id"]).collect()}
    for r in rows:
        g = _naive_grams(r["text"])
        share = {k: sum(x in m for x in g) / len(g) for k, m in member.items()} if g else {}
        if share:
            assert abs(got[r["doc_id"]]["score"] - max(share.values())) < 0.02
            assert share[got[r["doc_id"]]["lang_pred"]] > max(share.values()) - 0.02


def test_language_of_many_and_of_rare_letters(spark):
    rng = random.Random(1)
    words = {f"l{k:02}": ["".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(5)) for _ in range(8)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i, k in enumerate(sorted(words) * 4)]
    df = spark.createDataFrame([*rows, (5000, "\U00030001\U00030002\U00030001\U00030002 " * 5, "rare"), (5001, None, "l01"), (5002, "12", None)], "doc_id long, text string, score string")
    f = language.learn(df, lang="score")
    assert len(f.languages) == 71 and len(f.slots) == 2
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(df, f, df.columns).collect()}
    assert all(got[i] == k for i, _, k in rows) and (got[5000], got[5001], got[5002]) == ("rare", "und", "und")


def test_ftrl_against_a_plain_loop():
    import math

    import numpy as np

    rng = random.Random(3)
    data = [(rng.randrange(2), sorted(rng.sample(range(16), 4)), [rng.random() for _ in range(4)]) for _ in range(60)]
    fast, z, n = quality.Ftrl(bits=4), Counter(), Counter()
    a, b, l1, l2 = 0.5, 1.0, 1e-4, 1e-4

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for y, idx, val in data:
        fast.update(y, np.array(idx), np.array(val))
        x = {**dict(zip(idx, val, strict=True)), 16: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * w[i]
            n[i] += g * g
    m = fast.model()
    assert all(abs(m.weights[i] - weight(i)) < 1e-6 for i in range(16)) and abs(m.bias - weight(16)) < 1e-9


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    rows = Q.op5_quality(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("score", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9


def _least_capacity(sizes, k):
    best = [0] + [sum(sizes[:i]) for i in range(1, len(sizes) + 1)]
    for _ in range(k - 1):
        best = [min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


def test_sharding_is_minimax(spark):
    rng = random.Random(3)
    texts = ["x" * rng.choice([1, 5, 9, 40, 200]) + str(i % 23) for i in range(60)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    rows = sharding.shard(df, 4).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["key"], [0, set()])
        groups[r["key"]][0] += r["size"]
        groups[r["key"]][1].add(r["shard"])
    assert all(len(s) == 1 for _, s in groups.values())
    order = sorted(groups)
    assert [min(groups[k][1]) for k in order] == sorted(min(groups[k][1]) for k in order)
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) == _least_capacity([groups[k][0] for k in order], 4)
    for s in load:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)


def test_media(spark, docs):
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in media.digest(docs).collect():
        raw = text[r["doc_id"]].encode()
        pad = raw + bytes(-len(raw) % 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    (t,) = media.tracks(media.mux(bytes(range(64)) * 40))
    assert (t["codec"], t["duration"], t["samples"], list(t["key"])) == ("raw ", 2560, 40, [0, 16, 32])
    assert media.tracks(None) == [] and media.tracks(b"\0\0\0\x08moov") == [] and media.tracks(media.mux(bytes(64))[:300]) == []
    rng, whole = random.Random(6), media.mux(bytes(range(256)) * 8)
    deep = b""
    for _ in range(1500):
        deep = media.box(b"moov", deep)
    hostile = [deep, *(media.box(b"moov", media.box(b"trak", media.box(k, b"\0" * n))) for k in (b"mdhd", b"stz2", b"stsz", b"stsc", b"stts", b"stss", b"stsd", b"stco", b"co64") for n in (0, 4, 8, 12))]
    for _ in range(1500):
        b = bytearray(whole[: rng.randrange(len(whole))] if rng.random() < 0.3 else whole)
        for _ in range(rng.randrange(6)):
            if b:
                b[rng.randrange(len(b))] = rng.choice((0, 1, 255, rng.randrange(256)))
        hostile.append(bytes(b))
    for b in hostile:
        for t in media.tracks(b):
            assert len(t["at"]) == 0 or (t["at"].min() >= 0 and (t["at"] + t["size"]).max() <= len(b) and t["key"].max(initial=0) < len(t["at"]))
    files = spark.createDataFrame([(1, media.mux(bytes(128))), (2, None)], "id int, content binary")
    assert sorted((r["id"], len(r["tracks"])) for r in media.index_media(files).collect()) == [(1, 1), (2, 0)]


def test_fixity(spark):
    recs = spark.createDataFrame([(0, i, 100, f"d{i}") for i in range(40)] + [(1, i, 100, f"d{i}") for i in range(50, 60)], "archive long, id long, length long, digest string")
    a = save(warc.with_offsets(recs), "a")
    b = save(a.where("id <> 7").withColumn("digest", F.when(F.col("id").isin(3, 55), "bad").otherwise(F.col("digest"))), "b")
    got = {r["id"]: r["status"] for r in warc.audit(a, b, range_bytes=300, fan=2).collect()}
    assert got == {3: "corrupt", 55: "corrupt", 7: "missing"}
    assert warc.audit(a, a).count() == 0
    # Repeated and null ids: every record keeps its own offset, and clean ones are not accused.
    rows = [(1, "u", f"page {k}") for k in range(3)] + [(1, "u", "same")] * 2500 + [(None, "n", f"none {k}") for k in range(4)] + [(None, None, None), (2100, "v", "w")]
    recs = warc.with_offsets(warc.records(spark.createDataFrame(rows, "page_id long, url string, html string")))
    got, at = recs.collect(), {}
    assert len(got) == len(rows)
    for r in sorted(got, key=lambda r: (r["archive"] is None, r["archive"] or 0, r["offset"])):
        assert r["offset"] == at.get(r["archive"], 0)
        at[r["archive"]] = r["offset"] + r["length"]
    m = save(recs, "m")
    hit = F.col("digest") == m.where("id is null").agg(F.min("digest")).first()[0]
    found = warc.audit(m, m.withColumn("digest", F.when(hit, "bad").otherwise(F.col("digest"))), range_bytes=4000).collect()
    assert [(r["id"], r["status"]) for r in found] == [(None, "corrupt")] and warc.audit(m.limit(0), m.limit(0)).count() == 0


def test_lines(spark):
    passage = "\n".join(f"{'word ' * 12}p{i}" for i in range(12))
    unique = lambda k: "\n".join(f"{k} line {i} alone {k * i}" for i in range(6))
    long = "only " * 60
    rows = [(i, f"{unique(i)}\n{passage}\n{unique(i + 50)}" if i < 4 else f"{unique(i)}\n{long}" if i < 7 else unique(i)) for i in range(1, 9)]
    out = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    assert out[1]["text"] == text[1] and out[4]["text"] == text[4] and out[7]["text"] == text[7] and out[8]["removed_lines"] == 0
    for i in (2, 3):
        assert out[i]["removed_lines"] >= 6 and all(x in out[i]["text"] for x in unique(i).split("\n"))
    for i in (5, 6):
        assert out[i]["text"] == unique(i) and out[i]["removed_chunks"] == 1


def test_lines_repeated_runs_go_whole(spark):
    own = lambda k: [f"{k} own {j} text {k * 7 + j}" for j in range(3)]
    rows, want = [], {}
    for n in range(2, 6):
        for trial in range(10):
            key = n * 100 + trial
            run = [" ".join(f"w{key}x{j}y{i}" for i in range(60 // n)) for j in range(n)]
            if trial == 9:
                run.insert(1, "")
            for k in (key * 2, key * 2 + 1):
                rows.append((k, "\n".join(own(k) + run + own(k + 5000))))
                want[k] = "\n".join(own(k) + run * (k % 2 == 0) + own(k + 5000))
    # Two long lines with a blank one between them; copies in one text.
    big = " ".join(f"b{i}" for i in range(60))
    block = "\n".join("same words again and again" for _ in range(11))
    rows += [(1, f"one\n{big} 1\n\n{big} 2\nend one"), (2, f"two\n{big} 1\n\n{big} 2\nend two"), (3, f"three\n{block}\n{block}\nend three")]
    want |= {1: rows[-3][1], 2: "two\nend two", 3: f"three\n{block}\nend three"}
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == want


def test_lines_of_repeated_and_null_ids(spark):
    long = " ".join(f"r{i}" for i in range(60))
    rows = [(None, f"{long}\ny"), (None, "UNIQUE ONE\nkeep me"), (7, f"{long}\nz"), (7, "OTHER FIRST LINE\nsecond"), (9, f"{long}\nlast"), (9, f"{long}\nlast"), (3, None), (4, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __gone string")
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "__gone", "text", "n_lines", "removed_chunks", "removed_lines"]
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(None, "y"), (None, rows[1][1]), (7, rows[2][1]), (7, rows[3][1]), (9, "last"), (9, "last"), (3, None), (4, "")])


def _line_units(text):
    """All chunks and shortest runs of a text that count, as (start, end), by a plain loop over the rules."""
    import xxhash

    def signed_mod(t):
        h = xxhash.xxh64_intdigest(t.encode(), seed=42)
        return (h - (1 << 64) if h >> 63 else h) % lines._MOD

    rows = text.split("\n")
    words = [len([w for w in re.split(r"[ \t\x0b\f\r]+", x) if w]) for x in rows]
    small, out, at = [signed_mod(x) for x in rows], set(), 0
    for i in range(len(rows)):
        rolled = sum(small[i - k] * pow(lines._PRIME, k, lines._MOD) for k in range(lines.WINDOW) if i - k >= 0)
        if rolled % lines._MOD % lines.DIVISOR == 0 or words[i] > 50 or i + 1 == len(rows) or words[i + 1] > 50:
            n = sum(words[at : i + 1])
            if (i + 1 - at >= 2 and n >= 20) or n > 50:
                out.add((at, i + 1))
            at = i + 1
    full = [i for i in range(len(rows)) if words[i]]
    for i in full:
        ends = [e for e in range(i + 1, len(rows) + 1) if sum(words[i:e]) > 50]
        begins = [s for s in range(i, -1, -1) if sum(words[s : i + 1]) > 50]
        blank = max([k + 1 for k in full if k < i], default=0)
        out |= {(s, ends[0]) for s in (i, blank) if ends} | ({(begins[0], i + 1)} if begins else set())
    return out


def test_lines_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [r for r in rows if len(r[1]) < 6000]
    seen, gone = {}, {i: set() for i, _ in rows}
    places = [(i, s, e, t.split("\n")) for i, t in sorted(rows) for s, e in sorted(_line_units(t))]
    for i, s, e, t in places:
        first = seen.setdefault(tuple(t[s:e]), (i, e))
        if first[0] != i or s >= first[1]:
            gone[i] |= set(range(s, e))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}
    assert any(gone.values())
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def test_urls(spark):
    cases = ["http://A.Example.NET/en/x?q", "https://example.net/fr/", "http://x.net", "http://badexample.net/en/1", "http://www.example.com/de/#a", "ftp://a.org/fr/b", "no url", None, "http://h.com?x/de/", "http://bad.com/1", "http://good.com/1", "http://sub.bad.com/1"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    seen = [("bad.com", 1)] * 60 + [("bad.com", 0)] * 2 + [("good.com", 0)] * 60 + [("", 1)]
    out = {r["page_id"]: r for r in urls.judge(pages, spark.createDataFrame(seen, "host string, bad int"), keep=["page_id"]).collect()}
    for i, u in enumerate(cases):
        m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[2].lower(), m[3]) if m else ("", "")
        fit = max(((len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, fit[1])
        if fit[1]:
            assert out[i]["verdict"] == fit[2]
    assert (out[9]["verdict"], out[10]["verdict"], out[11]["verdict"]) == ("block", "allow", "block")
    none = urls.judge(pages, spark.createDataFrame([], "host string, bad int"), keep=["page_id"]).collect()
    assert len(none) == len(cases) and all(r["verdict"] == "allow" for r in none if not r["rule"])


def test_reputation_in_closed_form(spark):
    rng, seen = random.Random(8), []
    for d in ("a.com", "b.com", "c.org", "x.co.uk", "y.co.uk", "10.0.0.1"):
        for sub in range(5):
            p = rng.random()
            seen += [(d if d[0] == "1" else f"s{sub}.{d}", int(rng.random() < p)) for _ in range(rng.randrange(1, 40))]
    n, bad = Counter(h for h, _ in seen), Counter(h for h, b in seen if b)
    domain = {h: h if h[0] == "1" else h.split(".", 1)[1] for h in n}
    suffix = {d: "" if d[0] == "1" else d.split(".", 1)[1] for d in domain.values()}

    def up(counts, to):
        out = Counter()
        for k, c in counts.items():
            out[to[k]] += c
        return out

    def strength(n, bad, keys, mean):
        total, unit = sum(n[k] for k in keys), mean * (1 - mean)
        spread = sum(n[k] * (bad[k] / n[k] - mean) ** 2 for k in keys)
        beyond = (spread - (len(keys) - 1) * unit) / max(total - sum(n[k] ** 2 for k in keys) / total, 1e-9)
        return urls.STRONGEST if beyond <= 0 or unit <= 0 else max(urls.WEAKEST, min(urls.STRONGEST, unit / beyond - 1))

    dn, db = up(n, domain), up(bad, domain)
    sn, sb = up(dn, suffix), up(db, suffix)
    m0 = sum(sb.values()) / sum(sn.values())
    k0 = strength(sn, sb, list(sn), m0)
    sm = {s: (sb[s] + k0 * m0) / (sn[s] + k0) for s in sn}
    sk = {s: strength(dn, db, [d for d in dn if suffix[d] == s], sm[s]) for s in sn}
    dm = {d: (db[d] + sk[suffix[d]] * sm[suffix[d]]) / (dn[d] + sk[suffix[d]]) for d in dn}
    dk = {d: strength(n, bad, [h for h in n if domain[h] == d], dm[d]) for d in dn}
    want = {h: (bad[h] + dk[domain[h]] * dm[domain[h]]) / (n[h] + dk[domain[h]]) for h in n}
    want |= {"new.a.com": dm["a.com"], "user@s9.a.com:80": dm["a.com"], "new.co.uk": sm["co.uk"], "other.xyz": m0}
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(want)], "page_id long, url string")
    out = {r["host"]: r for r in urls.judge(pages, spark.createDataFrame(seen, "host string, bad int"), rules=[], limit=0.4).collect()}
    strong = {"new.a.com": dk["a.com"], "user@s9.a.com:80": dk["a.com"], "new.co.uk": sk["co.uk"], "other.xyz": k0} | {h: n[h] + dk[domain[h]] for h in n}
    for h, m in want.items():
        bound = m - urls.Z * (m * (1 - m) / (strong[h] + 1)) ** 0.5
        assert abs(out[h]["bad_rate"] - m) < 1e-9 and abs(out[h]["bad_bound"] - bound) < 1e-9 and out[h]["verdict"] == ("block" if bound > 0.4 else "allow")
    assert urls.judge(pages.limit(0), spark.createDataFrame(seen, "host string, bad int")).count() == 0


def _norm(t):
    return [w for w in re.split(r"[\W_]+", t.lower()) if w]


def _windows(words, item):
    """Best similarity of an item-sized window of words, by brute force over all of them; a shorter text is one window."""
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    want, best = Counter(grams(item)), 0.0
    for s in range(max(1, len(words) - len(item) + 1)):
        part = words[s : s + len(item)]
        if len(part) >= min(5, len(item)):
            have = Counter(grams(part))
            both = sum((want & have).values())
            best = max(best, both / (want.total() + have.total() - both))
    return best


def test_decontamination(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    some = [(r["item_id"], _norm(r["text"])) for r in items.collect()]
    pairs = set()
    for d in docs.collect():
        w = _norm(d["text"])
        held = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for i, q in some:
            # without a shingle in common no window has any similarity
            if any(tuple(q[k : k + 5]) in held for k in range(len(q) - 4)) and _windows(w, q) >= 0.8:
                pairs.add((d["doc_id"], i))
    got = {(r["doc_id"], i) for r in decontam.decontaminate(docs, items).collect() for i in r["item_ids"]}
    assert got == pairs and pairs


def test_decontamination_of_all_windows_and_its_recall(spark):
    rng, words = random.Random(2), [f"w{i}" for i in range(300)]
    own = [[rng.choice(words) for _ in range(n)] for n in (3, 5, 14, 23, 41, 41, 60, 200)] + [["a", "b"] * 20]
    rows = [(900, " ".join(["a", "b"] * 18)), (901, " ".join(own[6][:52])), (902, " ".join(own[6][:40])), (903, None), (None, " ".join(own[4])), (None, "x y"), (904, " ".join(own[4][:-4]))]
    for t in range(400):
        w = list(own[rng.randrange(2, len(own))])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = "other"
        rows.append((t, " ".join([rng.choice(words) for _ in range(rng.randrange(9))] + w + [rng.choice(words) for _ in range(rng.randrange(9))])))
    df, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(own)], "item_id long, text string")
    best = {t: {i: _windows(t.split(), w) for i, w in enumerate(own)} for _, t in rows if t}
    got = {r["text"]: r["item_ids"] for r in decontam.decontaminate(df, items).join(df, "doc_id").collect()}
    near = [(t, i) for t, b in best.items() for i, x in b.items() if x >= 0.8 and t in got]
    edge = [(t, i) for t, i in near if best[t][i] <= 0.85]
    assert all(best[t][i] >= 0.8 for t in got if t for i in got[t])
    assert len(edge) > 20 and sum(i in got[t] for t, i in edge) >= 0.95 * len(edge) and sum(i in got[t] for t, i in near) >= 0.98 * len(near)
    key = lambda d: {(r["key"], r["item_id"], r["start"], r["words"]) for r in d.collect()}
    assert key(decontam.find(df, items)) == key(decontam.find(df, items, anchored=False))
    assert [r["contaminated"] for r in decontam.decontaminate(df, items).where("doc_id is null").collect()].count(True) == 1
    left = decontam.without_matches(df.withColumn("__key", F.lit(1)), items)
    assert left.columns == ["doc_id", "text", "__key"] and [r["text"] for r in left.where("doc_id is null").collect()] == ["x y"]


def test_hamming_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(64) for _ in range(20)]
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    wins = [(k, 7, signed(flip(base[k % 20], k % 30))) for k in range(400)]
    items = [(i, 7, signed(x)) for i, x in enumerate(base)]
    want = {(k, i): d for k, _, x in wins for i, _, y in items if (d := ((x ^ y) & (2**64 - 1)).bit_count()) <= decontam.RADIUS}
    got = decontam.near_pairs(spark.createDataFrame(wins, "key long, words int, fp long"), spark.createDataFrame(items, "item_id long, words int, fp long")).collect()
    assert len(got) == len(want) and {(r["key"], r["item_id"]): r["distance"] for r in got} == want


def test_decontamination_of_near_passages(spark):
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    near, far = list(words), list(words)
    near[30] = "other"
    for i in range(5, 60, 9):
        far[i] = "other"
    df = spark.createDataFrame([(1, "x y " + " ".join(near).upper() + " z"), (2, "x y " + " ".join(far)), (3, " ".join(words[:50])), (4, "a b c"), (5, " ".join(words[:40]))], "doc_id long, text string")
    # 3: a text of 46 of the item's 56 shingles and no other is similar by 0.82; it is shorter than the item and one window.
    assert {r["doc_id"] for r in decontam.decontaminate(df, items).where("contaminated").collect()} == {1, 3}


def _sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def _components(sets, num, den):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("where", ["table", "families"])
def test_near_duplicates(spark, docs, where):
    if where == "table":
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    else:
        rng, rows = random.Random(5), []
        for f in range(6):
            base = [f"f{f}w{rng.randrange(400)}" for _ in range(150)]
            for _ in range(25):
                w = list(base)
                for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                    w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
                rows.append((len(rows), " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), num=85, den=100).collect()
    sets = _sets(rows)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == _components(sets, 85, 100)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    t, other = " ".join(f"w{i}" for i in range(12)), " ".join(f"o{i}" for i in range(12))
    rows = [(1, other), (1, t), (2, t), (3, f"{t} m"), (None, f"{t} m"), (None, " ".join(f"n{i}" for i in range(9))), (None, None), (4, " "), (5, other)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __row string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, num=80, den=100).collect())
    assert got == Counter([(1, 8, 1, True), (1, 8, 1, True), (2, 8, 1, False), (3, 9, 1, False), (None, 9, 1, False), (None, 5, None, True), (None, 0, None, True), (4, 0, 4, True), (5, 8, 1, False)])
    left = neardup.thinned(df.unionByName(df))
    assert left.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(1, other), (1, t), rows[5], *[(None, None)] * 2, *[(4, " ")] * 2])
    assert neardup.thinned(df.limit(0)).count() == 0


def test_near_duplicates_of_one_large_family(spark):
    rng, base = random.Random(9), [f"b{i}" for i in range(200)]
    rows = []
    for k in range(5000):
        w = list(base)
        w[rng.randrange(200)] = f"e{k}"
        rows.append((k, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), num=85, den=100)
    assert got.where("component_id = 0").count() == 5000


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = save(stage(spark, docs, SF), name)
        assert new.columns == docs.columns and dict(new.dtypes) == dict(docs.dtypes) and 0 < new.count() <= docs.count()
        docs = new
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == docs.count()


def test_pipeline_on_awkward_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    plain = docs.where("lang = 'en' and length(text) between 300 and 900").orderBy("doc_id").limit(2).collect()
    rows = [(None, item), (None, f"{plain[0]['text']} one more word"), (77, None), (77, ""), (77, "12 34"), (77, plain[1]["text"]), (77, plain[1]["text"])]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], docs.schema)
    wide = docs.where("lang = 'en'").unionByName(more)
    for c in ("score", "lang_pred", "__id", "__key", "__row", "__text", "__gone", "__lines", "removed_lines", "n_lines", "key", "id", "v", "row", "stays"):
        wide = wide.withColumn(c, F.lit("x"))
    now, size = wide, wide.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = save(stage(spark, now, SF), name)
        left = now.collect()
        assert now.columns == wide.columns and 0 < len(left) <= size
        size = len(left)
        assert stage(spark, wide.limit(0), SF).count() == 0
        if name == "language_id":
            assert not [r for r in left if not r["text"] or r["text"] == "12 34"]
        if name == "near_dedup":
            assert sum(r["text"] == plain[1]["text"] for r in left) <= 1 and not [r for r in left if (r["text"] or "").endswith("one more word")]
        if name == "decontamination":
            assert not [r for r in left if r["text"] == item]
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
    assert corpus_pipeline.STAGES[-1][1](spark, now.limit(0), SF).count() == 0


def test_rows_without_an_id_are_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(None, "der Hund und die Katze", "de", "s", 1), (None, "the dog and the cat", "en", "s", 1), (1, "the dog and the cat", "en", "s", 1), (2, "der Hund und die Katze", "de", "s", 1)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (Q.op2_language_id, Q.op5_quality):
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == 4 and all(r["held_out"] is True for r in rows if r["doc_id"] is None) and not any(r["held_out"] is None for r in rows)
    assert Q.op3_sharding(spark, str(tmp_path)).count() == Q.op4_media(spark, str(tmp_path)).count() == 4
