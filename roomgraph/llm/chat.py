"""Chat formatting: a state machine over roles and a declarative template.

``format_chat`` walks the turns of each conversation in order, checks every role against the
machine's transitions and emits three segments a turn (opening mark, escaped text, closing mark),
each with its loss flag. ``read_back`` parses such segments again without the source table.

A turn's place in its conversation is (turn, role, text), so repeated turn numbers have a fixed
order; null turns come first, null roles and texts are empty, rows without conversation id make up
one conversation. A role that the template doesn't name is written out in its mark, gets no loss
and breaks the turn order. Any other column of the input is ignored. Rows stream through a task
that holds one batch, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomgraph.llm.common import small_batches, text_of


@dataclass(frozen=True)
class ChatTemplate:
    """Marks, loss flags and allowed turn order.

    Inside texts ``escape`` is put before itself, before ``head`` and before ``close``; so none of
    them stands unescaped but in a mark.
    """

    head: str = "###"
    names: dict[str, str] = field(default_factory=lambda: {
        "system": "System", "user": "User", "assistant": "Assistant"})
    close: str = "</turn>"
    after: str = "\n"
    escape: str = "\\"
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "instructed", ("start", "user"): "asked",
        ("instructed", "user"): "asked", ("asked", "assistant"): "answered",
        ("answered", "user"): "asked"})
    final: frozenset[str] = frozenset({"asked", "answered"})

    def hide(self, text: str) -> str:
        e = self.escape
        return text.replace(e, e + e).replace(self.head, e + self.head).replace(
            self.close, e + self.close)

    def opening(self, role: str) -> str:
        if role in self.names:
            return f"{self.head} {self.names[role]}: "
        named = self.hide(role).replace(")", self.escape + ")")
        return f"{self.head} Other({named}): "

    def reader(self) -> re.Pattern:
        e, head, close = map(re.escape, (self.escape, self.head, self.close))
        names = "|".join(map(re.escape, self.names.values()))
        return re.compile(
            rf"{e}(?P<plain>{e}|{head}|{close})"
            rf"|{head} (?:(?P<name>{names})|Other\((?P<other>(?:{e}(?:{e}|{head}|{close}|\))|[^)])*?)\)): "
            rf"|(?P<close>{close}{re.escape(self.after)})"
            rf"|(?P<text>[^{e}{re.escape(self.head[0])}{re.escape(self.close[0])}]+|.)",
            re.DOTALL)


SEGMENTS = "conv_id long, seq long, state string, error string, loss boolean, segment string"
BACK = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, valid boolean, error string")


def format_chat(
    turns: DataFrame, template: ChatTemplate | None = None, conv: str = "conv_id",
    turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per segment: conv_id, seq (from 0 in the conversation), the machine's state after
    the turn, error (null, or what broke the order), loss flag and text."""
    template = template or ChatTemplate()
    small_batches(turns.sparkSession)
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        text_of(role).alias("role"), text_of(text).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_now, state, seq = object(), "", 0
        for batch in batches:
            out: list[tuple] = []
            for key, _, who, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != conv_now:
                    conv_now, state, seq = key, template.start, 0
                nxt = template.moves.get((state, who))
                error = None if nxt else f"{who!r} after {state}"
                # the machine goes on from where a known role leads
                state = nxt or next((b for (_, r), b in template.moves.items() if r == who), state)
                learn = who in template.loss
                for loss, piece in ((False, template.opening(who)), (learn, template.hide(said)),
                                    (False, template.close + template.after)):
                    out.append((key, seq, state, error, loss, piece))
                    seq += 1
            yield _batch(out, SEGMENTS)

    return rows.mapInArrow(walk, SEGMENTS)


def read_back(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Parse formatted segments: per conversation the turns' and the loss mask's digests."""
    template = template or ChatTemplate()
    small_batches(segments.sparkSession)
    pattern, role_of = template.reader(), {v: k for k, v in template.names.items()}
    escaped = re.compile(rf"{re.escape(template.escape)}({'|'.join(map(re.escape, (template.escape, template.head, template.close, ')')))})")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, mine = False, None, None
        for batch in batches:
            out: list[tuple] = []
            for key, _, state, error, loss, piece in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                if not started or key != conv:
                    if started:
                        out.append(mine.row(conv))
                    started, conv, mine = True, key, _Reading(template)
                mine.chars += len(piece)
                mine.state, mine.error = state, mine.error or error
                plain = []
                for m in pattern.finditer(piece):
                    kind = m.lastgroup
                    if kind == "name":
                        mine.open(role_of[m["name"]])
                    elif kind == "other":
                        mine.open(escaped.sub(r"\1", m["other"]))
                    elif kind == "close":
                        mine.close()
                    else:
                        plain.append(m[kind])
                said = "".join(plain)
                mine.turns.update(said.encode())
                if loss:
                    mine.loss.update(said.encode())
                    mine.loss_chars += len(said)
            yield _batch(out, BACK)
        if started:
            yield _batch([mine.row(conv)], BACK)

    return (segments.select("conv_id", "seq", "state", "error", "loss", "segment")
            .repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(walk, BACK))


class _Reading:
    """What has been read of one conversation."""

    def __init__(self, template: ChatTemplate):
        self.template, self.turns, self.loss = template, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.state, self.error = template.start, None

    def open(self, role: str) -> None:
        self.n += 1
        self.turns.update(f"{role}\n".encode())

    def close(self) -> None:
        self.turns.update(b"\n")

    def row(self, conv) -> tuple:
        ok = self.error is None and self.state in self.template.final
        return (conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.chars, ok, self.error)


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
        names=[name for name, _ in fields])
