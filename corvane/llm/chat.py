"""Chat formatting with a grammar round trip: what is rendered is parsed again, and what does not come back alike is escaped.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. The parser is deterministic: turns one after the other; a role up to
the end of its line, a text up to the first control string, which must be the end; anything else is an error. Each turn is
first rendered as it is and parsed; a field that does not come back identical is escaped and the turn parsed again, until it
is the source. An escape puts a backslash after the ``<`` of every control string in the field, before the backslashes there,
and the parser takes one away from each such string, so texts that hold escapes themselves come back too. A line end in a role
becomes ``<|im_line|>``. No control string can arise across the border of two turns, so turns parsed one by one and a conversation
parsed whole give the same.

Rendering and round trip are done turn by turn, without a shuffle. What needs the order of a conversation (digests, lengths)
streams over sorted rows with one hash state in memory, so a conversation of any length is no group that is held. The loss mask is a
place and length in code points: the assistants' texts as they stand in the output.

Null role or text: empty. Null turn: before all others. Equal turns: by role, then by what is rendered; repeated rows are turns
of their own. Null conv_id: its rows form one conversation. No assistant row: nothing under the mask, the digest of nothing.
Very long texts: whole. Extra columns, whatever their names, are never read. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small_batches, tidy

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|im_line|>"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end|im_line)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end|im_line)\|>")
_BARE = re.compile(r"<\|(?:im_start|im_end|im_line)\|>")

PIECES = "conv_id string, turn long, role string, piece string, loss_start int, loss_length int"


class GrammarError(ValueError):
    """A text that no sequence of turns renders to."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", LINE)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the text as it stands) of each turn; raises where the grammar is broken."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise GrammarError(f"no turn begins at {at}")
        line = formatted.find("\n", at)
        role = formatted[at + len(START) : line] if line >= 0 else START
        if _BARE.search(role.replace(LINE, "\n")):
            raise GrammarError(f"no role at {at}")
        end = _BARE.search(formatted, line + 1)
        if end is None or end[0] != END or not formatted.startswith("\n", end.end()):
            raise GrammarError(f"a turn does not end after {line}")
        out.append((unescape(role.replace(LINE, "\n")), unescape(formatted[line + 1 : end.start()]), line + 1, end.start()))
        at = end.end() + 1
    return out


def _alike(formatted: str, role: str, text: str) -> bool:
    try:
        return [x[:2] for x in parse(formatted)] == [(role, text)]
    except GrammarError:
        return False


def render(role: str, text: str) -> str:
    """One turn, with those fields escaped that do not come back identical as they are."""
    plain = lambda r, t: f"{START}{r}\n{t}{END}\n"
    out = plain(role, text)
    if not _alike(out, role, text):
        as_role = role if _alike(plain(role, ""), role, "") else escape_role(role)
        as_text = text if _alike(plain("", text), "", text) else escape(text)
        out = plain(as_role, as_text)
        if not _alike(out, role, text):
            raise GrammarError("an escaped turn does not come back")
    return out


def format_turns(turns: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The output: a piece for each row, with the place of what counts for the loss; pieces in order are the conversation."""

    def work(frames):
        for f in frames:
            pieces = [render(r, t) for r, t in zip(f["role"], f["text"], strict=True)]
            spans = [parse(p)[0][2:] if r in learn else (0, 0) for p, r in zip(pieces, f["role"], strict=True)]
            yield pd.DataFrame({"conv_id": f["id"], "turn": pd.array(f["turn"].map(lambda x: None if x is None else int(x)), dtype="Int64"), "role": f["role"], "piece": pieces, "loss_start": [a for a, _ in spans], "loss_length": [b - a for a, b in spans]})

    small_batches(turns.sparkSession)
    # Numbers as text: pandas would round a null's neighbours.
    rows = turns.select(F.col(id_column).cast("long").cast("string").alias("id"), F.col(turn).cast("long").cast("string").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(tidy(work), PIECES)


class _Reading:
    """What is known of one conversation so far, from its output alone."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss = conv_id, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def read(self, piece: str, start: int, length: int) -> None:
        for role, text, _, _ in parse(piece):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        said = unescape(piece[start : start + length])
        self.learned.update(said.encode("utf-8", "surrogatepass"))
        self.loss += len(said)
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


READ = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """One row for each conversation, parsed from the formatted pieces in their order."""

    def work(frames):
        names, now = [c.split()[0] for c in READ.split(", ")], None
        for f in frames:
            done = []
            for conv, piece, start, length in zip(f["conv_id"], f["piece"], f["loss_start"], f["loss_length"], strict=True):
                conv = conv if isinstance(conv, str) else None
                if now is None or conv != now.conv_id:
                    done += [now.row()] if now is not None else []
                    now = _Reading(conv)
                now.read(piece, start, length)
            if done:
                yield pd.DataFrame(done, columns=names)
        if now is not None:
            yield pd.DataFrame([now.row()], columns=names)

    small_batches(pieces.sparkSession)
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "piece")
    out = ordered.select("conv_id", "piece", "loss_start", "loss_length").mapInPandas(tidy(work), READ)
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))


def round_trip(turns: DataFrame, **names) -> DataFrame:
    """Formats all conversations, writes the output to the shared folder and reads it back."""
    return read_back(save(format_turns(turns, **names), "formatted"))
