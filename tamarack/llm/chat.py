"""Chat formatting by a finite-state machine over roles.

A template is data: for each role the strings that open and close its turns and whether its texts are
learned, and the roles that may follow. The formatter walks a conversation's turns in order, checks
each transition and emits segments with a loss flag each; only texts of learned roles carry it. Every
character of a text that could begin a control string, and the escape itself, is escaped, so control
strings occur in the output only where the template put them, and ``read_back`` recovers the turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.shared import column, unclashed

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Control strings begin with a character of ``heads``. A role without an entry is named between ``named`` strings."""

    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("[OUT] ", "</s>", True)})
    follows: dict[str | None, tuple[str, ...]] = field(default_factory=lambda: {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    named: tuple[str, str, str] = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
    heads: str = "[<"

    def __post_init__(self) -> None:
        bad = [c for c in self.controls() if c.lstrip(" ")[:1] not in self.heads or not c.strip()]
        if bad:
            raise ValueError(f"control strings must begin with one of {self.heads!r}: {bad}")

    def controls(self) -> list[str]:
        return [c for opens, closes, _ in self.roles.values() for c in (opens, closes)] + list(self.named)

    def escape(self, text: str) -> str:
        return re.sub(f"[{re.escape(self.heads + ESCAPE)}]", lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Formatter:
    """One conversation's state: the role before, and whether every turn so far was in order."""

    def __init__(self, template: Template):
        self.template, self.before, self.valid = template, None, True

    def turn(self, role: str, text: str) -> Iterator[tuple[str, bool]]:
        t = self.template
        self.valid &= role in t.follows.get(self.before, ())
        self.before = role
        if role in t.roles:
            opens, closes, learned = t.roles[role]
            yield opens, False
        else:
            yield t.named[0], False
            yield t.escape(role), False
            yield t.named[1], False
            closes, learned = t.named[2], False
        yield t.escape(text), learned
        yield closes, False

    def done(self) -> bool:
        return self.valid and self.before in self.template.ends


class Reader:
    """Recovers roles, texts and the text under the loss mask from segments, by their characters alone.

    A closing string's leading space belongs to it: a text is what stands between the strings.
    """

    def __init__(self, template: Template):
        self.template = template
        self.openers = {opens: role for role, (opens, _, _) in template.roles.items()}
        self.token = re.compile("|".join(map(re.escape, sorted(template.controls(), key=len, reverse=True))) + r"|\\.|[^\\ " + re.escape(template.heads) + r"]+|.", re.S)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.role: str | None = None
        self.closes, self.naming, self.body = "", False, []

    def feed(self, text: str, loss: bool) -> None:
        self.formatted_chars += len(text)
        t = self.template
        for m in self.token.finditer(text):
            x = m[0]
            if self.closes and x == self.closes:
                if self.naming:
                    self.role, self.naming, self.closes = "".join(self.body), False, t.named[2]
                else:
                    self.turns.update(f"{self.role}\n{''.join(self.body)}\n".encode())
                    self.n_turns += 1
                    self.closes = ""
                self.body = []
            elif not self.closes:
                if x == t.named[0]:
                    self.naming, self.closes = True, t.named[1]
                elif x in self.openers:
                    self.role = self.openers[x]
                    self.closes = t.roles[self.role][1]
                else:
                    raise ValueError(f"text outside a turn: {x!r}")
            else:
                self.body.append(x[1] if x[0] == ESCAPE else x)
        if loss:
            plain = unescape(text)
            self.loss.update(plain.encode())
            self.loss_chars += len(plain)


SEGMENTS = "conv_id long, segment long, text string, loss boolean, valid boolean"


def _format(template: Template):
    def run(batches):
        conv, formatter, at = object(), None, 0
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if c != conv or formatter is None:
                    if formatter is not None:
                        out.append((conv, at, "", False, formatter.done()))
                    conv, formatter, at = c, Formatter(template), 0
                for x, loss in formatter.turn(role, text):
                    out.append((conv, at, x, loss, formatter.valid))
                    at += 1
            if out:
                yield _batch(out)
        if formatter is not None:
            yield _batch([(conv, at, "", False, formatter.done())])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "segment", "text", "loss", "valid"])


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments (conv_id, segment, text, loss, valid) of each conversation, in order within their partition.

    Turns are ordered by turn, ties by role and text; null texts and roles are empty. ``valid`` tells
    whether the order of turns was legal up to there; the empty segment that ends each conversation,
    whether all of it was. Illegal conversations are formatted all the same. Rows without a conv_id
    are one conversation; an empty table gives no segments; other columns play no part, whatever their names. One shuffle deals out the turns; tasks stream over them, so memory follows
    neither the length of a conversation nor their number.
    """
    turns = unclashed(turns, "conv_id", "turn", "role", "text")
    empty = lambda c: F.coalesce(column(turns, c, "string"), F.lit(""))
    rows = turns.select(column(turns, "conv_id", "long").alias("conv_id"), column(turns, "turn", "long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format(template or Template()), SEGMENTS)


def _read(template: Template):
    def run(batches):
        reader = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        for batch in batches:
            out = []
            for conv, segment, text, loss, valid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment == 0:
                    reader = Reader(template)
                reader.feed(text, loss)
                if not text and not loss and not reader.closes:  # only the end mark is empty outside a turn
                    out.append((conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.formatted_chars, valid))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid), parsed from ``format_chats``'s output as it comes."""
    return segments.mapInArrow(_read(template or Template()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
