"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Its
insides are not looked at: ``locate`` renders successive turn prefixes and
compares consecutive outputs. What a prefix adds to the output of the one
before is its last turn's span; an output that does not begin with the one
before means that the template rewrites history, and where it first differs is
reported.

``TagTemplate`` marks turns by ``<s>role`` and ``</s>`` and breaks control
strings inside roles and texts by a backslash after their first character,
reversibly, so that no escaped text holds one; ``parse`` reads turns back from
formatted output alone.

``format_conversations`` sorts each conversation's turns and formats it. Rows
are dealt by ``conv_id``; one conversation is one output text, so its own turns
meet in one task, streamed, a conversation at a time.

Defined results: a null text or role is empty; turns of equal number are
ordered by role, then text; a null turn number comes first; rows whose
``conv_id`` is null form one conversation; repeated rows are repeated turns; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

Turn = tuple[str, str]
FORMATTED = "conv_id long, n_turns int, formatted string, spans array<struct<start:int,end:int>>, loss array<struct<start:int,end:int>>, rewritten array<int>"


class TagTemplate:
    """``<s>role\\ntext</s>\\n`` a turn. Reserved strings inside roles and texts
    get a backslash after their first character, and a backslash is doubled."""

    # Strings that formatted output reserves.
    RESERVED = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def __init__(self) -> None:
        broken = "|".join(f"{re.escape(x[0])}(?={re.escape(x[1:])})" for x in self.RESERVED)
        self._escape = re.compile(rf"\\|{broken}")
        self._turn = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!/s>))*)</s>\n", re.DOTALL)
        self._back = re.compile(r"\\(.)", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._back.sub(r"\1", text)

    def __call__(self, turns: list[Turn]) -> str:
        return "".join("<s>" + self.escape(role).replace("\n", "\\\n") + "\n" + self.escape(text) + "</s>\n" for role, text in turns)

    def parse(self, formatted: str) -> list[Turn]:
        out, at = [], 0
        while at < len(formatted):
            m = self._turn.match(formatted, at)
            if not m:
                raise ValueError(f"not formatted output at {at}")
            out.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return out

    def body(self, formatted: str, start: int, end: int) -> tuple[int, int]:
        """The text's part, still escaped, of a turn's span."""
        m = self._turn.fullmatch(formatted, start, end)
        if not m:
            raise ValueError("not a turn's span")
        return m.span(2)


@dataclass
class Located:
    formatted: str
    spans: list[tuple[int, int]]
    #: (turn, first character that it changed) of turns that rewrite history
    rewritten: list[tuple[int, int]]


def locate(turns: list[Turn], render: Callable[[list[Turn]], str]) -> Located:
    """Spans by comparing the outputs of successive prefixes."""
    before, spans, rewritten = render([]), [], []
    for k in range(1, len(turns) + 1):
        now = render(turns[:k])
        if now.startswith(before):
            spans.append((len(before), len(now)))
        else:
            same = len(os.path.commonprefix([before, now]))
            rewritten.append((k - 1, same))
            spans.append((same, len(now)))
        before = now
    return Located(before, spans, rewritten)


def conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Conversations out of rows that are sorted by conversation and turn."""
    key, turns, any_rows = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if any_rows and conv != key:
                yield key, turns
                turns = []
            key, any_rows = conv, True
            turns.append((role or "", text or ""))
    if any_rows:
        yield key, turns


def format_conversations(rows: DataFrame, template: Callable[[list[Turn]], str] | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row a conversation: formatted text, each turn's span, the loss mask
    (text parts of turns whose role is learned) and the turns that rewrote
    history. A template without ``body`` masks whole spans. Where any turn rewrote
    history, the spans before it may no longer hold: the mask of the whole
    conversation is empty, and ``rewritten`` says why."""
    template = template or TagTemplate()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size = 0
        for conv, turns in conversations(batches):
            got = locate(turns, template)
            body = getattr(template, "body", lambda _, a, b: (a, b))
            loss = [body(got.formatted, a, b) for (role, _), (a, b) in zip(turns, got.spans, strict=True) if role in learn] if not got.rewritten else []
            pair = lambda x: {"start": x[0], "end": x[1]}
            out.append({"conv_id": conv, "n_turns": len(turns), "formatted": got.formatted, "spans": [pair(x) for x in got.spans], "loss": [pair(x) for x in loss], "rewritten": [k for k, _ in got.rewritten]})
            size += len(got.formatted)
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int32()), ("formatted", pa.string()), ("spans", span), ("loss", span), ("rewritten", pa.list_(pa.int32()))])
    turns = pick(rows, conv_id="long", turn="long", role="string", text="string")
    dealt = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(made, FORMATTED)


def read_back(formatted: DataFrame, template: TagTemplate | None = None) -> DataFrame:
    """Digests from the formatted text and masks alone."""
    import hashlib

    template = template or TagTemplate()
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                turns = template.parse(text)
                learned = "".join(template.unescape(text[x["start"] : x["end"]]) for x in loss)
                out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(made, schema)
