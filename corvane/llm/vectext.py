"""Words of many texts as arrays: one pass of numpy over the UTF-8 bytes instead of a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are worked on at once; about 25 times as much memory is used meanwhile. One longer text goes alone.
BLOCK_BYTES = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as UTF-8, each of at most ``limit`` bytes or a single text; null counts as empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if held and size + len(b) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield first, held


class Words:
    """The words (runs of bytes other than space and 0x09-0x0D) of a run of texts, A-Z lower-cased.

    buf: the bytes, a line end after each text; start, length: of each word; doc: its text's place in the run;
    first: place of each text's first word, with the number of words at the end; hash: 64 bits of each word.
    """

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.buf = _LOWER[self.raw]
        inside = ~_SPACE[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.length = self.end - self.start
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.byte_at = np.flatnonzero(inside)
        self.offset = np.concatenate(([0], np.cumsum(self.length)[:-1])) if len(self.length) else np.zeros(0, np.int64)
        self.place = np.arange(len(self.byte_at)) - np.repeat(self.offset, self.length)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each word of one value for each of its bytes."""
        return np.add.reduceat(values, self.offset) if len(self.offset) else np.zeros(0, values.dtype)

    def hashes(self, keep: np.ndarray | None = None) -> np.ndarray:
        """64 bits of each word; keep: the bytes that count, for all 256."""
        if not len(self.offset):
            return np.zeros(0, np.uint64)
        power = np.ones(int(self.length.max()), np.uint64)
        if len(power) > 1:
            power[1:] = _BASE
            np.multiply.accumulate(power, out=power)
        byte = self.buf[self.byte_at]
        value = (byte.astype(np.uint64) + np.uint64(1)) * power[self.place]
        if keep is not None:
            value *= keep[byte]
        return mix(self.sums(value))


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and the text of each; a text of fewer words, but one, has its whole run as one."""
    h, n = words.hashes(), len(words.doc)
    factor = np.uint64(0xD1342543DE82EF95)
    whole = max(0, n - k + 1)
    run = np.zeros(whole, np.uint64)
    for i in range(k):
        run = run * factor + h[i : i + whole]
    same = words.doc[:whole] == words.doc[k - 1 :] if whole else np.zeros(0, bool)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    extra = np.zeros(len(short), np.uint64)
    for j, d in enumerate(short):
        v = 0
        for x in h[words.first[d] : words.first[d + 1]].tolist():
            v = (v * int(factor) + x) & 0xFFFFFFFFFFFFFFFF
        extra[j] = (v + int(count[d]) * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
    doc = np.concatenate((words.doc[:whole][same], short))
    out = mix(np.concatenate((run[same], extra)))
    order = np.argsort(doc, kind="stable") if len(short) else slice(None)
    return out[order], doc[order]
