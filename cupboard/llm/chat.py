r"""Conversations as training text: windows of whole turns within a token budget, with a loss mask.

A turn is written as ``<turn ROLE>\nTEXT</turn>\n``. Control strings inside a text are escaped with a backslash
(``\`` as ``\\``, ``<turn`` as ``<\turn``, ``</turn`` as ``<\/turn``), so the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

TARGET, SYSTEM = "assistant", "system"
_CONTROL = re.compile(r"\\|(?<=<)(?=/?turn)")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<turn ([^>\n]*)>\n(.*?)</turn>\n", re.DOTALL)

WINDOWS = ("conv_id long, window long, formatted string, loss array<struct<begin:long,end:long>>, repeated int, "
           "n_tokens long, over_budget boolean")
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head = f"<turn {quote(role, safe='')}>\n"
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of every turn of a formatted window."""
    return [(unquote(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


class _Windows:
    """Windows of one conversation, fed turn by turn.

    Prefix sums of turn tokens, counted as the turns are written, decide where a window ends: it takes new turns while
    the system turn, the repeated history and the new turns fit the budget. Only one window and the history are held,
    however long the conversation is. A turn that does not fit beside the system turn gets a window of its own,
    without history and over the budget.
    """

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, str, int] | None = None
        self.past: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []
        self.sums = [0]
        self.count = 0

    def _kept(self, first: int) -> list[tuple[str, str, int]]:
        """The system turn, then as many of the latest repeated turns as leave room for ``first`` tokens."""
        system = [self.system] if self.system else []
        room = self.budget - sum(t[2] for t in system) - first
        sums = [0]
        for turn in reversed(self.past):
            sums.append(sums[-1] + turn[2])
        n = max(0, bisect_right(sums, room) - 1)
        return system + self.past[len(self.past) - n:]

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple[int, str, list, int, int, bool]]:
        if self.new and self.sums[-1] + tokens > self.budget - sum(t[2] for t in self._kept(self.new[0][2])):
            yield self._close()
        self.new.append((role, text, tokens))
        self.sums.append(self.sums[-1] + tokens)

    def _close(self) -> tuple[int, str, list, int, int, bool]:
        kept = self._kept(self.new[0][2])
        pieces, loss, at = [], [], 0
        for i, (role, text, _) in enumerate([*kept, *self.new]):
            written, begin, end = write_turn(role, text)
            if role == TARGET and i >= len(kept):
                loss.append({"begin": at + begin, "end": at + end})
            pieces.append(written)
            at += len(written)
        for turn in self.new:
            if turn[0] == SYSTEM and self.system is None:
                self.system = turn
            else:
                self.past = [*self.past, turn][-self.history:] if self.history else []
        tokens = sum(t[2] for t in kept) + self.sums[-1]
        number, self.new, self.sums, self.count = self.count, [], [0], self.count + 1
        return number, "".join(pieces), loss, len(kept), tokens, tokens > self.budget

    def finish(self) -> Iterator[tuple[int, str, list, int, int, bool]]:
        if self.new:
            yield self._close()


def _by_conversation(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation in one partition and in order; equal turn numbers are ordered by role and text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_windows(conversations: DataFrame, tokenizer: str, budget: int = 1024, history: int = 2) -> DataFrame:
    """Windows of every conversation, in order within each partition.

    ``loss`` holds the code point spans of the assistant texts in ``formatted`` that are to be learned; a repeated
    assistant turn is left out of it, so every assistant turn is a target once. ``repeated`` counts the leading
    turns that an earlier window holds: the first system turn, which every window keeps, and up to ``history``
    turns before the window. ``n_tokens`` counts the formatted text; ``over_budget`` marks windows of one new turn that is too
    long for the budget beside the system turn; no other window exceeds it. NULL role and text count as empty; a NULL conv_id is a conversation; no rows give none.
    """
    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        conv, state = object(), _Windows(budget, history)
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv_id != conv:
                    out += [(conv, *w) for w in state.finish()]
                    conv, state = conv_id, _Windows(budget, history)
                out += [(conv, *w) for w in state.add(role, text, len(encode(write_turn(role, text)[0])))]
            yield _batch(out)
        yield _batch([(conv, *w) for w in state.finish()])

    return _by_conversation(conversations).select("conv_id", "role", "text").mapInArrow(windows, WINDOWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), _SPANS, pa.int32(), pa.int64(), pa.bool_())
    names = ["conv_id", "window", "formatted", "loss", "repeated", "n_tokens", "over_budget"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss: list[dict], repeated: int) -> None:
        self.chars += len(formatted)
        for role, text, _, _ in read_turns(formatted)[repeated:]:
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in loss:
            text = unescape(formatted[span["begin"]:span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)

    def row(self, conv_id: int | None) -> tuple:
        return (conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_back(windows: DataFrame, in_order: bool = False) -> DataFrame:
    """One row per conversation, read from its windows. Windows that come straight from ``format_windows`` are
    ``in_order``; others, such as those of a table, are gathered and sorted first. A missing window raises ValueError."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, due = None, None, 0
        for batch in batches:
            done = []
            for conv_id, window, formatted, loss, repeated in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if state is None or conv_id != conv:
                    done += [state.row(conv)] if state else []
                    conv, state, due = conv_id, _Digest(), 0
                if window != due:
                    raise ValueError(f"conversation {conv_id}: window {window} where {due} was due")
                due += 1
                state.add(formatted, loss, repeated)
            yield rows(done)
        yield rows([state.row(conv)] if state else [])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    rows_in = windows.select("conv_id", "window", "formatted", "loss", "repeated")
    if not in_order:
        rows_in = rows_in.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows_in.mapInArrow(digests, schema)
