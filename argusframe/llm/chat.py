"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Rows of a conversation, in order of turn (ties: role, then text; nulls first), stream through the machine,
which tests the order of roles and emits text segments, each with its own loss flag. Control strings inside
texts are escaped, so the segments read back to the very turns. A conversation is never held as a whole:
the longest thing in memory is one turn.

Nulls: null text or role is the empty string; a null conv_id is a conversation of its own. Roles outside the
template break its order but are written and read back all the same. Repeated rows are turns like any other. Very
long texts: a turn is escaped and written whole, in memory linear in its length. Empty tables give no
conversations. Extra columns of any name are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusframe.llm.common import map_rows


@dataclass(frozen=True)
class Template:
    """Control strings for the start, for each role and for other roles; who may follow whom; who is learned."""

    begin: str = "<s>"
    opens: dict[str, str] = field(default_factory=lambda: {"system": "<<SYS>>", "user": "[INST]", "assistant": "[/INST]"})
    closes: dict[str, str] = field(default_factory=lambda: {"system": "<</SYS>>", "user": "<eot>", "assistant": "</s>"})
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", "<<END>>")
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})
        }
    )
    learned: frozenset[str] = frozenset({"assistant"})

    @property
    def controls(self) -> list[str]:
        return [self.begin, *self.opens.values(), *self.closes.values(), *self.other]

    def escaper(self):
        """A backslash goes before every backslash and every place where a control string starts."""
        stops = re.compile("(?=" + "|".join(map(re.escape, ["\\", *self.controls])) + ")")
        return lambda text: stops.sub(lambda _: "\\", text)

    def scanner(self):
        return re.compile(r"\\(.)|(" + "|".join(re.escape(c) for c in sorted(self.controls, key=len, reverse=True)) + ")", re.S)


class Writer:
    """The machine that writes: one call a turn, yielding (text, loss flag, order is valid so far)."""

    def __init__(self, template: Template):
        self.template, self.escape = template, template.escaper()
        self.role, self.valid = "", True

    def turn(self, role: str, text: str, first: bool) -> Iterator[tuple[str, bool, bool]]:
        t = self.template
        if first:
            self.role, self.valid = "", True
        self.valid = self.valid and role in t.follows.get(self.role, ())
        self.role = role
        head = t.begin if first else ""
        if role in t.opens:
            opened, closed = t.opens[role], t.closes[role]
        else:
            opened, closed = t.other[0] + self.escape(role) + t.other[1], t.other[2]
        yield head + opened, False, self.valid
        yield self.escape(text), role in t.learned, self.valid
        yield closed, False, self.valid


class Reader:
    """The machine that reads: fed segments in order, it rebuilds the turns and digests them."""

    def __init__(self, template: Template):
        self.template, self.scan = template, template.scanner()
        self.opened = {v: k for k, v in template.opens.items()}
        self.closed = {*template.closes.values(), template.other[2]}
        self.turns = self.chars = self.loss_chars = 0
        self.turns_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()
        self.role: str | None = None
        self.held: list[str] = []

    def plain(self, text: str, loss: bool) -> None:
        self.held.append(text)
        if loss:
            self.loss_chars += len(text)
            self.loss_digest.update(text.encode("utf-8", "surrogatepass"))

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        at = 0
        for m in self.scan.finditer(text):
            if m.start() > at:
                self.plain(text[at : m.start()], loss)
            at = m.end()
            if m[1] is not None:
                self.plain(m[1], loss)
            elif m[2] in self.opened:
                self.role, self.held = self.opened[m[2]], []
            elif m[2] == self.template.other[0]:
                self.held = []
            elif m[2] == self.template.other[1]:
                self.role, self.held = "".join(self.held), []
            elif m[2] in self.closed:
                said = "".join(self.held)
                self.turns_digest.update(f"{self.role}\n{said}\n".encode("utf-8", "surrogatepass"))
                self.turns += 1
                self.held = []
        if at < len(text):
            self.plain(text[at:], loss)

    def result(self) -> tuple[int, str, int, str, int]:
        return self.turns, self.turns_digest.hexdigest(), self.loss_chars, self.loss_digest.hexdigest(), self.chars


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments: conv_id, segment (from 0), text, loss, valid. Those of a conversation stay together, in
    order, in one partition: the rows are dealt by conv_id and sorted there, then streamed."""
    template = template or Template()
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(
            F.col("role").cast("string"), F.lit("")
        ).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def make():
        writer, now, n = Writer(template), [], 0

        def one(conv_id: int | None, _turn: int | None, role: str, text: str) -> Iterator[tuple]:
            nonlocal n
            first = now != [conv_id]
            if first:
                now[:] = [conv_id]
                n = 0
            for said, loss, valid in writer.turn(role, text, first):
                yield conv_id, n, said, loss, valid
                n += 1

        return one

    return map_rows(dealt, make, "conv_id long, segment long, text string, loss boolean, valid boolean")


def read_back(segments: DataFrame, template: Template | None = None, ordered: bool = False) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.
    ``ordered`` says that the segments come straight from :func:`format_conversations`; else they are dealt
    and sorted first."""
    template = template or Template()
    rows = segments.select("conv_id", "segment", "text", "loss", "valid")
    if not ordered:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    ends = rows.mapInArrow(
        _reading(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )
    return ends


def _reading(template: Template):
    import pyarrow as pa

    from argusframe.llm.common import emit

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches):
        reader, key, valid, out = None, None, True, []
        for batch in batches:
            for conv_id, segment, text, loss, ok in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment == 0:
                    if reader:
                        out.append((key, *reader.result(), valid))
                    reader, key = Reader(template), conv_id
                reader.feed(text, loss)
                valid = ok
            if len(out) >= 5_000:
                yield emit(names, out, types)
                out = []
        if reader:
            out.append((key, *reader.result(), valid))
        if out:
            yield emit(names, out, types)

    return run
