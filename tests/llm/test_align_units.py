"""Units are encoded many at once and their groups found together: what it saves, and that it changes nothing."""

import random

import pytest

from corvane.llm import align
from corvane.llm import queries as Q


class Counted:
    """A tokenizer that counts the texts it is given; off: what it says of joined texts is wrong."""

    def __init__(self, inner, off=False):
        self.inner, self.off, self.texts = inner, off, 0

    def encode(self, text, **how):
        self.texts += 1
        return self.inner.encode(f"{text} x" if self.off else text, **how)

    def encode_batch(self, texts, **how):
        self.texts += len(texts)
        return self.inner.encode_batch(texts, **how)


@pytest.fixture
def pair():
    return align.Pair(Q.tokenizer_path("byte_bpe_50k.json"), Q.tokenizer_path("piece_bpe_32k.model"))


def texts(n=400):
    rng = random.Random(8)
    odd = ["ﬁne", "½", "a\x00b", "<|endoftext|>", "</s>", "日本語", "é" * 9, "don't", "x\x1cy", "\x85z", "…--", "1234567"]
    word = lambda: rng.choice(odd) if rng.random() < 0.05 else "".join(rng.choice("abcdeiortnsAZ09,.") for _ in range(rng.randrange(1, 14)))
    return [None, "", " ", "\n", " \n a  b\n", *(rng.choice([" ", "\n", "  ", " \n "]).join(word() for _ in range(rng.randrange(1, 60))) + rng.choice(["", " ", "\n"]) for _ in range(n))]


def test_many_units_are_one_text_for_the_tokenizer(pair):
    pair.a = Counted(pair.a)
    pair.block([" ".join(f"w{i}q{i * i}" for i in range(5000))])
    assert len(pair.unit) == 5000 and pair.a.texts <= 5000 // align.UNITS_AT_ONCE + 2


def test_together_or_one_by_one_is_the_same(pair):
    rows = texts()
    flat, first, count = pair.block(rows)
    assert len(flat) == sum(count) and [bool(w) for w in first] == [n > 0 for n in count]
    assert [";".join(pair.keys[g] for g in part) for part in (flat[sum(count[:i]) : sum(count[: i + 1])] for i in range(20))] == first[:20]
    for change in ({"a": Counted(pair.a, off=True)}, {"short_ids": False}, {"by_units": False}):
        for name, value in change.items():
            setattr(pair, name, value)
        pair.forget()
        assert pair.block(rows)[1] == first
    pair.forget()
    assert [pair.block([t])[1][0] for t in rows] == first  # each text as a block of its own
