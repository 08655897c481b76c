"""Chat formatting in windows of a token budget.

A turn is written as ``<|im_start|>role`` line break ``text<|im_end|>`` line
break.  Inside roles and texts every ``<|``, and every ``<`` and ``|`` with
only backslashes between them, gets one backslash more, so that no control
string can occur there and reading takes one away.

1. Turns are dealt by range of (conversation, turn); each task escapes and
   counts its turns and sums tokens along each conversation.  What lies before
   a task's first conversation is a row for each task, so a conversation may
   be spread over any number of them.
2. The prefix sum decides the span: turns that start within the same stride of
   tokens are new in the same window; the last of them, which may reach beyond
   the stride, gets a window of its own where the budget would be exceeded.
   Spans are aligned to turns and found without walking the conversation.
3. A window holds the system turn (the conversation's first turn, if that is
   its role), then as much of the history before the span as HISTORY and the
   budget leave, in whole turns, then the new turns.  History never reaches
   further back than the stride before, so a window is made from a group that
   the budget bounds.
4. The loss mask covers the texts of new assistant turns alone: every
   assistant text is a target once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweft.llm.shared import cut
from tallyweft.llm.tokens import Counts, byte_bpe_path

#: Tokens of a window, and of the history that a window repeats at most.
BUDGET, HISTORY = 2048, 256
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, ANSWERS = "system", "assistant"
#: Pre-tokens whose counts a task remembers, and window characters that are written at once.
KNOWN, CHARS = 1 << 18, 1 << 24

_CLOSED, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _CLOSED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


TURNS = "conv_id long, part long, own long, tokens long, role string, body string"
WINDOWS = "conv_id long, first long, repeated int, new int, tokens long, text string, loss_from array<long>, loss_to array<long>"
FORMATTED = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, windows long, most_tokens long"


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)


def _batches(rows: Iterator[tuple], schema: str, wide: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a bounded number of rows and, where ``wide`` names a text column, of its characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[wide]) if wide is not None else 0
        if len(held) == 4096 or chars >= CHARS:
            yield _arrow(held, schema)
            held, chars = [], 0
    if held:
        yield _arrow(held, schema)


def _counted(path: str):
    """Sorted (conv_id, role, text) rows to TURNS; ``own`` is the tokens of the conversation before the turn in this task."""

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        counts, known = Counts(path), {}

        def size(text: str) -> int:
            total = 0
            for word, n in counts.frequencies(text).items():
                pieces = known.get(word)
                if pieces is None:
                    if len(known) == KNOWN:
                        known.clear()
                    pieces = known[word] = counts.pieces(word)
                total += n * pieces
            return total

        part, of, own = TaskContext.get().partitionId(), object(), 0
        for conv, role, text in _rows(batches):
            if conv != of:
                of, own = conv, 0
            role, body = escape_role(role), escape(text)
            tokens = size(f"{START}{role}\n{body}{END}\n")
            yield conv, part, own, tokens, role, body
            own += tokens

    return lambda batches: _batches(turns(batches), TURNS, 5)


def _window(conv: int | None, first: int, shown: list[tuple], new: list[tuple]) -> tuple:
    """A row of WINDOWS from (tokens, role, body) turns: those repeated, and those new."""
    out, at, begins, ends = [], 0, [], []
    for k, (_, role, body) in enumerate(shown + new):
        head = f"{START}{role}\n"
        if k >= len(shown) and role == ANSWERS:
            begins.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return conv, first, len(shown), len(new), sum(t[0] for t in shown + new), "".join(out), begins, ends


def _spans(system: list[tuple], before: list[tuple], new: list[tuple], budget: int) -> Iterator[tuple[int, list[tuple]]]:
    """The windows of a stride: how many of its turns are earlier, and its turns."""
    held = sum(t[1] for t in system)
    if len(new) > 1 and held + new[-1][0] + new[-1][1] - new[0][0] > budget:
        yield 0, new[:-1]
        yield len(new) - 1, new[-1:]
    else:
        yield 0, new


def _framed(budget: int, history: int):
    """Sorted rows (conv_id, cell, kind, start, tokens, role, body) to WINDOWS; kind 0: system, 1: before the stride, 2: new."""

    def made(conv: int | None, cell: int, rows: list[tuple]) -> Iterator[tuple]:
        system, before, new = ([r[3:] for r in rows if r[2] == kind] for kind in range(3))
        fresh = cell == 0  # the system turn itself is new in the first window
        if not new:
            if system and fresh:
                yield _window(conv, 0, [], [t[1:] for t in system])
            return
        for at, span in _spans(system, before, new, budget):
            room = min(history, budget - sum(t[1] for t in system) - sum(t[1] for t in span))
            shown, end = [], span[0][0]
            for turn in reversed(before + new[:at]):
                if turn[0] + turn[1] != end or span[0][0] - turn[0] > room:
                    break
                shown.insert(0, turn[1:])
                end = turn[0]
            head = [t[1:] for t in system]
            if fresh and not at:
                yield _window(conv, 0, [], head + [t[1:] for t in span])
            else:
                yield _window(conv, span[0][0], head + shown, [t[1:] for t in span])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        of, rows = None, []
        for row in _rows(batches):
            if row[:2] != of:
                if rows:
                    yield from made(*of, rows)
                of, rows = row[:2], []
            rows.append(row)
        if rows:
            yield from made(*of, rows)

    return lambda batches: _batches(windows(batches), WINDOWS, 5)


def windows(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY, path: str | None = None) -> DataFrame:
    """Rows of WINDOWS: the formatted text, how many of its turns are repeated and new, and the spans of the loss mask.

    Turns follow each other by ``turn`` (null first), equal ones by role and
    then by a hash of the text.  A null text or role counts as empty, rows
    without a conversation are one conversation, repeated rows are turns of
    their own; an empty table gives an empty result; other columns are not
    read.  A turn longer than the budget stands in a window of its own, after
    the system turn; such windows alone, and those of a system turn over half
    the budget, exceed it.  Nothing is cut off.
    """
    spark = turns.sparkSession
    history = min(history, budget // 3)
    stride = max(1, (budget - history) // 2)
    own = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", F.md5("text"), F.monotonically_increasing_id()]
    keyed = own.select("conv_id", "turn", "role", order[3].alias("tie"), order[4].alias("line"), "text")
    keys = ["conv_id", "turn", "role", "tie", "line"]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "role", "text")
    counted = cut(dealt.mapInArrow(_counted(path or byte_bpe_path()), TURNS), "turns")

    # of each task only its first conversation can have begun before
    totals = counted.groupBy("conv_id", "part").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    carried = totals.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), before.alias("_before")).where("_before > 0")
    same = (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    placed = counted.join(F.broadcast(carried), same, "left").withColumn("start", F.col("own") + F.coalesce("_before", F.lit(0).cast("long")))
    placed = placed.withColumn("cell", F.floor(F.col("start") / stride))
    first = (F.col("start") == 0) & (F.col("role") == SYSTEM)
    late = ~first & (F.col("start") + history >= (F.col("cell") + 1) * stride)
    kinds = F.when(first, F.array(F.lit(0))).when(late, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(2)))
    each = placed.select("conv_id", "cell", "start", "tokens", "role", "body", F.explode(kinds).alias("kind"))
    columns = ["conv_id", "cell", "kind", "start", "tokens", "role", "body"]
    each = each.withColumn("cell", F.col("cell") + F.when(F.col("kind") == 1, 1).otherwise(0)).select(*columns)
    system = placed.where(first).select(F.col("conv_id").alias("_conv"), "start", "tokens", "role", "body")
    cells = placed.where((F.col("cell") > 0) & ~first).select("conv_id", "cell").distinct()
    again = cells.join(system, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("kind", F.lit(0)).select(*columns)
    grouped = each.unionByName(again).repartition("conv_id", "cell").sortWithinPartitions("conv_id", "cell", "kind", "start")
    return grouped.mapInArrow(_framed(budget, history), WINDOWS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows to FORMATTED; a conversation's windows pass one by one."""

    class Conversation:
        def __init__(self, conv):
            self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
            self.n = self.loss_chars = self.chars = self.windows = self.most = 0

        def add(self, repeated, tokens, text, begins, ends):
            new = parse(text)[repeated:]
            for role, said in new:
                self.turns.update(f"{role}\n{said}\n".encode())
            for a, b in zip(begins, ends, strict=True):
                said = unescape(text[a:b])
                self.loss.update(said.encode())
                self.loss_chars += len(said)
            self.n += len(new)
            self.chars += len(text)
            self.windows += 1
            self.most = max(self.most, tokens)

        def row(self):
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows, self.most

    def rows() -> Iterator[tuple]:
        now = None
        for conv, *window in _rows(batches):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now.row()
                now = Conversation(conv)
            now.add(*window)
        if now is not None:
            yield now.row()

    return _batches(rows(), FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row of FORMATTED for each conversation, from its windows alone.

    A SHA-256 has no parallel form, so one task reads the windows of a
    conversation; it holds one window at a time.
    """
    narrow = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "first")
    return narrow.select("conv_id", "repeated", "tokens", "text", "loss_from", "loss_to").mapInArrow(_read, FORMATTED)


def format_and_read(turns: DataFrame, **how) -> DataFrame:
    """Format all conversations, write the windows, and read each conversation back from them."""
    return read_back(cut(windows(turns, **how), "windows"))
