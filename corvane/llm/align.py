"""Alignment of two tokenizers by a group dictionary.

Each text is encoded by both; byte offsets where tokens of both end cut them into groups, which are short and few: words and
their parts. Distinct groups are interned. In a block of texts a group stands once, with the texts that hold it and how often;
over the corpus it is a row of a dictionary, keyed by its ids (``a1,a2|b1``). A group's links (every A token with every B token
in it) are expanded once for each distinct group, never for its occurrences: inside a block to count the texts that hold an
id pair, and over the dictionary to rate the group from the pairs' counts. The ratings are joined back by group key to the blocks,
multiplied by how often a text holds the group, and summed by text.

Texts are encoded by units: both tokenizers cut before a space or line end between two characters that are not white space (the
vocabularies are tried for it, else a text is one unit), so a unit's groups are found once and kept, in a bounded cache.

Keys that many texts share have a row for each block, not each text; a join on them is split where it is skewed. Broadcast is
one number for each id of A's vocabulary.

Null or empty text, or one whose joined bytes differ from a space and the text in either tokenizer: no tokens, all zero, '' as digest.
Null and repeated ids: each row for itself. Repeated rows: each counts as a document. Very long text: whole; it is one block's share.
Ties: all pairs with the highest count of their A id are best. Special tokens' strings are plain text. Other columns are never
read. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small_batches, tidy

#: Units that a task keeps with their groups; the dictionary starts anew when it is full.
CACHE_UNITS = 250_000
#: Pairs expanded at once, of groups that are themselves large.
PAIRS_AT_ONCE = 1_000_000
#: Units that A encodes as one text.
UNITS_AT_ONCE = 1_000
#: Numbers of A's and B's ids, of 16 bits each, that fit into one 64 bit number together.
SHAPES = ((1, 1), (1, 2), (2, 1), (1, 3), (2, 2), (3, 1))

FOUND = "kind int, block long, at int, id string, n_a long, n_b long, n_groups long, n_links long, key string, docs array<int>, times array<int>, a int, b int, n long"
DOC, GROUP, PAIR = 0, 1, 2

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest, in order, as letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}


def link_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A group's distinct id pairs and how many occurrence pairs each stands for."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    return np.repeat(ua, len(ub)), np.tile(ub, len(ua)), np.outer(ca, cb).ravel()


class Pair:
    """Both tokenizers and the groups of the units seen."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = _byte_of_letter()
        self.bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.length_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.length_a[[*self.bytes_a]] = [*map(len, self.bytes_a.values())]
        self.length_b = np.array([*map(len, self.bytes_b)], np.int64)
        self.short_ids = max(len(self.length_a), len(self.length_b)) <= 1 << 16
        with open(path_a, encoding="utf-8") as f:
            how = json.load(f)
        first = how.get("pre_tokenizer") or {}
        plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not how.get("normalizer")
        # Cut at a unit's border: no piece of B goes on over a space, or holds a line end beside anything else.
        self.by_units = bool(plain and self.space > 2 and not any(re.search("[^▁]▁|\n.|.\n", p) for p in pieces))
        self.forget()

    def forget(self) -> None:
        self.unit: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.begin = np.zeros(1, np.int64)  # where each unit's groups begin in flat, and the end of the last's
        self.flat = np.zeros(0, np.int64)
        self.group: dict[str, int] = {}
        self.code: dict[tuple[int, int], dict[int, int]] = {}
        self.keys: list[str] = []
        self.sizes: list[tuple[int, int]] = []
        self.pairs: list[np.ndarray] = []

    def _intern(self, a: list[int], b: list[int]) -> int:
        key = f"{','.join(map(str, a))}|{','.join(map(str, b))}"
        g = self.group.get(key)
        if g is None:
            g = self.group[key] = len(self.keys)
            self.keys.append(key)
            self.sizes.append((len(a), len(b)))
            x, y, _ = link_counts(np.array(a, np.int64), np.array(b, np.int64)) if len(a) * len(b) > 1 else (np.array(a, np.int64), np.array(b, np.int64), None)
            self.pairs.append((x << 32) | y)
        return g

    def _interned(self, a: np.ndarray, from_a: np.ndarray, n_a: np.ndarray, b: np.ndarray, from_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """The numbers of groups, stretches of a and b. Where a group's ids fit into one number together, each number is looked up once; others one by one."""
        out = np.full(len(n_a), -1, np.int64)
        for p, q in SHAPES if self.short_ids else ():
            at = np.flatnonzero((n_a == p) & (n_b == q))
            code = np.zeros(len(at), np.int64)
            for ids, begin, many in ((a, from_a, p), (b, from_b, q)):
                for k in range(many):
                    code = (code << 16) | ids[begin[at] + k]
            own, first, which = np.unique(code, return_index=True, return_inverse=True)
            known, found = self.code.setdefault((p, q), {}), []
            for c, f in zip(own.tolist(), at[first].tolist(), strict=True):
                g = known.get(c)
                if g is None:
                    g = known[c] = self._intern(a[from_a[f] : from_a[f] + p].tolist(), b[from_b[f] : from_b[f] + q].tolist())
                found.append(g)
            out[at] = np.array(found, np.int64)[which]
        rest = np.flatnonzero(out < 0)
        for g, fa, na, fb, nb in zip(rest.tolist(), *(x[rest].tolist() for x in (from_a, n_a, from_b, n_b)), strict=True):
            out[g] = self._intern(a[fa : fa + na].tolist(), b[fb : fb + nb].tolist())
        return out

    def _encoded_a(self, units: list[str], size: np.ndarray, together: bool) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all units, and how many each has. together: units are encoded many at once, if all their borders are tokens' ends then."""
        if together:
            ids = _flat([self.a.encode("".join(units[i : i + UNITS_AT_ONCE]), add_special_tokens=False).ids for i in range(0, len(units), UNITS_AT_ONCE)])
            ends, border = np.cumsum(self.length_a[ids]), np.cumsum(size)
            if len(ends) and ends[-1] == border[-1]:
                at = np.searchsorted(ends, border)
                if (ends[at] == border).all():
                    return ids, np.diff(at, prepend=-1)
        of = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        return _flat(of), np.array([*map(len, of)], np.int64)

    def learn(self, units: list[str]) -> None:
        """Encode units, which begin with a space or a line end. Those without white space at their other borders may stand beside each other."""
        inner = [len(u) > 1 and not u[1].isspace() and not u[-1].isspace() for u in units]
        for how in (True, False):
            if some := [u for u, x in zip(units, inner, strict=True) if x is how]:
                self._learn(some, how and self.by_units)

    def _learn(self, units: list[str], together: bool) -> None:
        raw = [u.encode() for u in units]
        size = np.array([*map(len, raw)], np.int64)
        a, n_a = self._encoded_a(units, size, together)
        of_b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        # B puts a space before any text.
        of_b = [x if u[0] == " " else x[1:] if x and x[0] == self.space else [] for u, x in zip(units, of_b, strict=True)]
        b, n_b = _flat(of_b), np.array([*map(len, of_b)], np.int64)
        # Good: on both sides the unit's bytes come back.
        good, whole = np.ones(len(units), bool), b"".join(raw)
        for ids, many, length, spelt in ((a, n_a, self.length_a, self.bytes_a), (b, n_b, self.length_b, self.bytes_b)):
            edge = _edges(length[ids])[_edges(many)]
            side = b"".join(map(spelt.__getitem__, ids.tolist()))
            if side != whole or (np.diff(edge) != size).any():
                good &= [side[lo:hi] == x for lo, hi, x in zip(edge[:-1].tolist(), edge[1:].tolist(), raw, strict=True)]
        a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a * good, n_b * good
        # A group ends where tokens of both end; so does each unit.
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at] == end_a)
        edge_a, edge_b = (np.concatenate(([0], x + 1)) for x in (last_a, at[last_a]))
        groups = self._interned(a, edge_a[:-1], np.diff(edge_a), b, edge_b[:-1], np.diff(edge_b))
        ends = np.searchsorted(last_a, np.cumsum(n_a) - 1, side="right")
        self.unit.update(zip(units, range(len(self.good), len(self.good) + len(units)), strict=True))
        self.good = np.concatenate((self.good, good))
        self.begin = np.concatenate((self.begin, self.begin[-1] + ends))
        self.flat = np.concatenate((self.flat, groups))

    def block(self, texts: list) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The groups of all texts, in order; each text's written out; how many each has."""
        if len(self.unit) > CACHE_UNITS:
            self.forget()
        split = [[] if not t else _CUT.split(f" {t}") if self.by_units else [f" {t}"] for t in texts]
        units = [*chain.from_iterable(split)]
        at = [*map(self.unit.get, units)]
        if None in at:
            self.learn([*dict.fromkeys(u for u, x in zip(units, at, strict=True) if x is None)])
            at = [*map(self.unit.__getitem__, units)]
        at, doc = np.array(at, np.int64), np.repeat(np.arange(len(texts)), [*map(len, split)])
        bad = np.unique(doc[~self.good[at]])
        if len(bad):
            # Units that do not come back: the whole text decides.
            whole = [f" {texts[d]}" for d in bad.tolist()]
            self.learn([*dict.fromkeys(w for w in whole if w not in self.unit)])
            instead = np.array([self.unit[w] for w in whole], np.int64)
            stay, fine = ~np.isin(doc, bad), self.good[instead]
            doc, at = np.concatenate((doc[stay], bad[fine])), np.concatenate((at[stay], instead[fine]))
            order = np.argsort(doc, kind="stable")
            doc, at = doc[order], at[order]
        many = self.begin[at + 1] - self.begin[at]
        flat = self.flat[np.repeat(self.begin[at] - _edges(many)[:-1], many) + np.arange(many.sum())]
        count = np.bincount(doc, weights=many, minlength=len(texts)).astype(np.int64)
        names, edge = [*map(self.keys.__getitem__, flat.tolist())], _edges(count).tolist()
        return flat, [";".join(names[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:], strict=True)], count


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)


def _edges(sizes: np.ndarray) -> np.ndarray:
    """Where stretches of these sizes begin, and where the last ends."""
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizers(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _pairs:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def _lists(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values, pa.int32()))


def _table(rows: int, **columns) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "block": pa.int64(), "at": pa.int32(), "id": pa.string(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "key": pa.string(), "docs": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "a": pa.int32(), "b": pa.int32(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in kinds.items()], list(kinds))


def found(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each block of texts: a row for each text, for each distinct group with the texts that hold it, and for each id pair with how many do."""

    def work(batches):
        pair = tokenizers(path_a, path_b)
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, n = batch.column(0), batch.num_rows
            flat, written, count = pair.block(batch.column(1).to_pylist())
            doc = np.repeat(np.arange(n), count)
            sizes = np.array(pair.sizes, np.int64).reshape(-1, 2)[flat]
            total = lambda w: np.bincount(doc, weights=w, minlength=n).astype(np.int64)  # noqa: E731, B023
            digests = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
            yield _table(n, kind=np.full(n, DOC), block=np.full(n, block), at=np.arange(n), id=ids, n_a=total(sizes[:, 0]), n_b=total(sizes[:, 1]), n_groups=count, n_links=total(sizes[:, 0] * sizes[:, 1]), key=digests)
            if len(flat):
                held, times = np.unique(flat * n + doc, return_counts=True)
                group, at = np.divmod(held, n)
                first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                own, edge = group[first], np.concatenate((first, [len(group)]))
                yield _table(len(own), kind=np.full(len(own), GROUP), block=np.full(len(own), block), key=[pair.keys[g] for g in own.tolist()], docs=_lists(at, edge), times=_lists(times, edge))
                # Links once for each group of the block; then the texts of a pair, each once.
                links = [pair.pairs[g] for g in own.tolist()]
                width = np.array([len(x) for x in links])
                code, local = np.unique(np.concatenate(links), return_inverse=True)
                begin = np.concatenate(([0], np.cumsum(width)))
                of = np.repeat(np.arange(len(own)), np.diff(edge))  # the group of each (group, text)
                many = width[of]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                by_text = local[np.repeat(begin[of], many) + step] * n + np.repeat(at, many)
                if len(own) < len(code) or (width > 1).any():
                    by_text = np.unique(by_text)
                times = np.bincount(by_text // n, minlength=len(code))
                yield _table(len(code), kind=np.full(len(code), PAIR), a=code >> 32, b=code & 0xFFFFFFFF, n=times)
            block += 1
        pair.forget()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").cast("string").alias("id"), text).mapInArrow(tidy(work), FOUND)


def expanded(keys: DataFrame) -> DataFrame:
    """(key, a, b, m): the links of each distinct group of the dictionary; m occurrence pairs have these ids."""

    def work(batches):
        names = ("key", "a", "b", "m")
        for batch in batches:
            held, size = [], 0
            for key in batch.column(0).to_pylist():
                a, b = (np.array(side.split(","), np.int64) for side in key.split("|"))
                x, y, m = link_counts(a, b) if len(a) * len(b) > 1 else (a, b, np.ones(1, np.int64))
                held.append((key, x, y, m))
                size += len(x)
                if size >= PAIRS_AT_ONCE:
                    yield _links(held, names)
                    held, size = [], 0
            if held:
                yield _links(held, names)

    return keys.select("key").mapInArrow(tidy(work), "key string, a int, b int, m long")


def _links(held: list, names: tuple[str, ...]) -> pa.RecordBatch:
    key = pa.array([h[0] for h in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), [len(h[1]) for h in held])))
    x, y, m = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
    return pa.RecordBatch.from_arrays([key, pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(m, pa.int64())], names=list(names))


def by_text(rated: DataFrame) -> DataFrame:
    """(block, at, n_best, count_sum) from a block's groups with their ratings; a block's rows follow one another."""

    def work(batches):
        now, best, total = None, None, None

        def row():
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now), pa.int64()), pa.array(at, pa.int32()), pa.array(best[at], pa.int64()), pa.array(total[at], pa.int64())], names=["block", "at", "n_best", "count_sum"])

        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            edge = np.concatenate(([0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                docs, times = (part.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
                many = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                if blocks[lo] != now:
                    if now is not None:
                        yield row()
                    now, best, total = int(blocks[lo]), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(docs) and (top := int(docs.max()) + 1) > len(total):
                    best, total = (np.concatenate((x, np.zeros(top - len(x), np.int64))) for x in (best, total))
                for held, column in ((best, 3), (total, 4)):
                    np.add.at(held, docs, times * np.repeat(part.column(column).to_numpy(zero_copy_only=False), many))
        if now is not None:
            yield row()

    ordered = rated.repartition("block").sortWithinPartitions("block")
    return ordered.select("block", "docs", "times", "best", "worth").mapInArrow(tidy(work), "block long, at int, n_best long, count_sum long")


def rated_groups(all_: DataFrame) -> DataFrame:
    """(key, best, worth): of each distinct group its links whose count is their A id's highest, and the sum of its links' counts."""
    pairs = all_.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("count"))
    pairs = save(pairs, "pairs")
    most = pairs.groupBy("a").agg(F.max("count").alias("most"))
    pairs = pairs.join(F.broadcast(most), "a")  # a row for each id of A's vocabulary
    keys = all_.where(F.col("kind") == GROUP).select("key").distinct()
    links = expanded(keys).join(pairs, ["a", "b"])
    return links.groupBy("key").agg(F.sum(F.when(F.col("count") == F.col("most"), F.col("m")).otherwise(0)).alias("best"), F.sum(F.col("m") * F.col("count")).alias("worth"))


def align(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    all_ = save(found(docs, path_a, path_b, id_column, text), "aligned")
    rated = all_.where(F.col("kind") == GROUP).select("key", "block", "docs", "times").join(rated_groups(all_), "key")
    sums = by_text(rated)
    own = all_.where(F.col("kind") == DOC).select("block", "at", "id", "n_a", "n_b", "n_groups", "n_links", F.col("key").alias("groups_sha256"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = own.join(sums, ["block", "at"], "left")
    return out.select(F.col("id").cast("long").alias(id_column), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, count): the table of links itself, with how many documents hold each id pair linked."""
    all_ = save(found(docs, path_a, path_b, id_column, text), "aligned")
    return all_.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("count"))
