"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " role ": " text "\n</turn>\n"

A role is percent-encoded unless it is plain.  Inside a text the control strings
``###`` and ``</turn>`` are literal only behind a backslash; the parser takes one
backslash away from a run of backslashes in front of a control string.  Each
turn is rendered, parsed again and compared with its source; as long as they
differ, the conflicting strings are escaped.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import slices

END = "\n</turn>\n"
#: A run of backslashes is tried once, from its start.
_CONTROL = re.compile(r"(?<!\\)(\\*)(###|</turn>)")
_HEAD = re.compile(r"### ([A-Za-z0-9_.~%-]*): ")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1][1:] + m[2], text)


class ParseError(ValueError):
    pass


class Parser:
    """Reads formatted text in chunks of any size; borders between chunks mean nothing."""

    def __init__(self) -> None:
        self.parts: list[str] = []  # not looked at yet
        self.tail = ""
        self.held, self.passed = "", 0  # text from the place ``passed`` of the whole

    def feed(self, chunk: str) -> Iterator[tuple[str, str, int]]:
        """The turns that end in ``chunk``: (role, escaped text, its place in the whole)."""
        self.parts.append(chunk)
        tail = self.tail + chunk
        self.tail = tail[-len(END) :]
        if END in tail:  # else no turn ends here
            yield from self._turns()

    def close(self) -> Iterator[tuple[str, str, int]]:
        """What is left; raises ParseError if that is not whole turns."""
        yield from self._turns()
        if self.held:
            raise ParseError(f"no turn at {self.passed}")

    def _turns(self) -> Iterator[tuple[str, str, int]]:
        held, at = self.held + "".join(self.parts), 0
        self.parts = []
        while head := _HEAD.match(held, at):
            close = next((m for m in _CONTROL.finditer(held, head.end()) if not m[1]), None)
            if close is None or len(held) < close.end() + 1:
                break  # not whole yet, or wrong: decided at the end
            start, end = head.end(), close.start() - 1
            if close[2] != "</turn>" or end < start or held[end : close.end() + 1] != END:
                raise ParseError(f"control string inside a turn at {self.passed + close.start()}")
            yield unquote(head[1]), held[start:end], self.passed + start
            at = close.end() + 1
        self.held, self.passed = held[at:], self.passed + at


def parse(chunks: Iterable[str]) -> Iterator[tuple[str, str, int, int]]:
    """Formatted text, in chunks of any size -> (role, text, start, end); start and end are the
    place of the escaped text in the whole.  Raises ParseError on anything the grammar lacks."""
    parser = Parser()
    for turns in (*map(parser.feed, chunks), parser.close()):
        for role, shown, start in turns:
            yield role, unescape(shown), start, start + len(shown)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, start, end): start and end bound the text inside the turn."""
    head = f"### {quote(role, safe='')}: "
    shown = text
    while True:
        turn = head + shown + END
        try:
            back = [t[:2] for t in parse([turn])]
        except ParseError:
            back = []
        if back == [(role, text)]:
            return turn, len(head), len(head) + len(shown)
        if shown != text:
            raise ValueError("an escaped turn does not read back")  # the grammar excludes it
        shown = escape(text)


def _rendered(turns: DataFrame) -> DataFrame:
    """Turns with ``head`` and, where the text had to be escaped, ``shown``: each turn is rendered and parsed
    again where it lies, before any shuffle."""
    schema = "conv_id long, turn long, role string, text string, head string, shown string"
    names = [f.split()[0] for f in schema.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            heads, shown = [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                chunk, start, end = render(role, text)
                heads.append(chunk[:start])
                shown.append(None if chunk[start:end] == text else chunk[start:end])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.string()), pa.array(shown, pa.string())], names)

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.mapInArrow(of, schema)


_FORMATTED = "conv_id long, seq long, role string, chunk string, loss_start long, loss_end long"


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, seq, role, chunk, loss_start, loss_end.

    A conversation's formatted text is its chunks in the order of ``seq``; the loss
    spans are code point places in that text, NULL for turns that are not trained
    on.  NULL roles and texts count as empty, a NULL conv_id is a conversation of
    its own, a NULL turn comes first; turns with one number are ordered by role, then text;
    repeated rows are turns of their own.  An empty table gives an empty result; other columns
    are not read.  Turns are rendered, read back and escaped before the shuffle; a conversation
    of any length then streams through a task that only numbers them and adds up places.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _FORMATTED.split(", ")]
        current: object = object()
        seq = at = 0
        for b in slices(batches):
            rows = []
            for conv_id, role, text, head, shown in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if conv_id != current:
                    current, seq, at = conv_id, 0, 0
                chunk = head + (text if shown is None else shown) + END
                span = (at + len(head), at + len(chunk) - len(END)) if role == loss_role else (None, None)
                rows.append((conv_id, seq, role, chunk, *span))
                seq, at = seq + 1, at + len(chunk)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ordered = _rendered(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(of, _FORMATTED)


class _Digest:
    """What is read back from one conversation's formatted text."""

    def __init__(self) -> None:
        self.parser, self.spans = Parser(), deque()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, chunk: str, span: tuple[int, int] | None) -> None:
        if span:
            self.spans.append(span)
        self.chars += len(chunk)
        self._take(self.parser.feed(chunk))

    def close(self) -> tuple[int, str, int, str, int]:
        self._take(self.parser.close())
        if self.spans:
            raise ParseError(f"the loss mask leaves the texts at {self.spans[0][0]}")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def _take(self, turns: Iterator[tuple[str, str, int]]) -> None:
        for role, shown, start in turns:
            self.turns.update(f"{role}\n{unescape(shown)}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
            while self.spans and self.spans[0][1] <= start + len(shown):
                a, z = self.spans.popleft()
                if a < start:
                    raise ParseError(f"the loss mask leaves the texts at {a}")
                masked = unescape(shown[a - start : z - start])
                self.loss.update(masked.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(masked)


def read_back(formatted: DataFrame) -> DataFrame:
    """Rows of :func:`format_conversations`, in any order -> one row per conversation: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, all taken from the formatted text and its spans.

    The chunks are read joined, in the order of ``seq``; where they are cut does not matter.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for b in slices(batches, "chunk"):
            done = []
            for conv_id, chunk, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if digest is None or conv_id != current:
                    if digest:
                        done.append((current, *digest.close()))
                    current, digest = conv_id, _Digest()
                digest.add(chunk, None if start is None else (start, end))
            yield batch_of(done)
        yield batch_of([(current, *digest.close())] if digest else [])

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.select("conv_id", "chunk", "loss_start", "loss_end").mapInArrow(of, schema)
