"""Conversations as training text in windows under a token budget.

Template, per turn: ``### role`` and a newline, the text, ``</turn>`` and a newline. Inside
roles and texts a backslash goes before each backslash, ``#`` and ``<`` (and newline, in a
role), so no text can hold a control string and every text can be read back.

Prefix sums of the turns' tokens choose windows of whole turns. Each window but the first
begins with the conversation's system turn, if its first turn is one, and repeats up to
`history` tokens of the turns before. Loss falls on the assistant texts that are new in
the window; repeated ones are masked. A turn that is larger than the budget gets a window
with the system turn alone, uncut.

No task holds a conversation. Turns are encoded where they are read. Their keys and token
counts alone, in order, stream past a planner that keeps the open window's sum and the
turns of its history, and says into which windows each turn goes. Texts join these places,
and what meets in one task is the turns of one window. So of a conversation with a third
of all rows only its counts are sequential.

Rows are taken by turn, then role, then the md5 of their text, nulls first; null roles and
texts are empty, a null conversation id is a conversation of its own. Repeated rows are
turns each. Copies of conversations stay apart by their ids. Empty tables give no windows.
"""

from __future__ import annotations

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, prepare, stored
from .tokens import encoder_of

CLOSE = "</turn>\n"
_TURN = re.compile(r"### ([^\\\n]*(?:\\.[^\\\n]*)*)\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and the start and end of its escaped text."""
    head = "### " + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class Planner:
    """Says, turn by turn, into which windows the turns of a conversation go."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.window, self.at, self.used, self.held = -1, 0, 0, 0
        self.system, self.recent = None, deque()

    def add(self, turn, tokens: int, is_system: bool) -> list[tuple]:
        """The places of the next turn, and of earlier ones that its window repeats: (window, number, repeated, turn)."""
        out = []
        if self.window < 0 or self.used + tokens > self.budget:
            self.window += 1
            self.used = self.system[1] if self.system else 0
            back = list(self.recent)
            keep, room = len(back), min(self.history, self.budget - self.used - tokens)
            while keep and back[keep - 1][1] <= room:
                keep -= 1
                room -= back[keep][1]
            if self.system:
                out.append((self.window, 0, True, self.system[0]))
            out += [(self.window, number, True, t) for t, _, number in back[keep:]]
            self.used += sum(n for _, n, _ in back[keep:])
        out.append((self.window, self.at, False, turn))
        self.used += tokens
        if not self.at and is_system:
            self.system = (turn, tokens)
        else:
            self.recent.append((turn, tokens, self.at))
            self.held += tokens
            while self.held > self.history:
                self.held -= self.recent.popleft()[1]
        self.at += 1
        return out


WINDOWS = "conv_id long, window long, n_tokens long, first_turn long, n_repeated long, text string, loss array<struct<start:long,end:long>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("window", pa.int64()),
        ("n_tokens", pa.int64()),
        ("first_turn", pa.int64()),
        ("n_repeated", pa.int64()),
        ("text", pa.string()),
        ("loss", pa.list_(_SPAN)),
    ]
)
_KEY = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("hash", pa.string())]
_COUNTED = pa.schema([*_KEY, ("copies", pa.int64()), ("text", pa.string()), ("tokens", pa.int64())])
_PLACED = pa.schema([("window", pa.int64()), ("number", pa.int64()), ("repeated", pa.bool_()), *((f"p_{n}", t) for n, t in _KEY)])


def streamed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with those of a key next to each other in one partition, in order; a partition is read in batches, never held."""
    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order)


def format_windows(
    conversations: DataFrame,
    tokenizer: str,
    budget: int = 1024,
    history: int = 256,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per window: its text, loss spans in characters, and how many of its leading turns are repeated."""
    prepare(conversations.sparkSession)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        text(role_col).alias("role"),
        text(text_col).alias("text"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", F.md5("text").alias("hash")).agg(
        F.count("*").alias("copies"),
        F.first("text").alias("text"),
    )

    def count(batches):
        encoder = encoder_of(tokenizer)
        for batch in batches:
            texts = [turn_text(r, t)[0] for r, t in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield batch_of(_COUNTED, [*batch.columns, encoder.counts(texts)])

    key = "conv_id long, turn long, role string, hash string"
    counted = stored(rows.mapInArrow(count, f"{key}, copies long, text string, tokens long"), "turns")

    def place(batches):
        now, planner = None, None
        for batch in batches:
            made = []
            for conv, turn, role, digest, copies, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if planner is None or conv != now:
                    now, planner = conv, Planner(budget, history)
                for _ in range(copies):
                    made += planner.add((conv, turn, role, digest), tokens, role == "system")
            cols = [list(c) for c in zip(*((w, n, again, *t) for w, n, again, t in made), strict=True)] or [[]] * 7
            yield batch_of(_PLACED, cols)

    numbers = streamed(counted.drop("text"), "conv_id", "turn", "role", "hash")
    places = numbers.mapInArrow(
        place,
        "window long, number long, repeated boolean, p_conv_id long, p_turn long, p_role string, p_hash string",
    )
    same = F.lit(True)
    for n, _ in _KEY:
        same = same & F.col(n).eqNullSafe(F.col(f"p_{n}"))
    parts = places.join(counted, same).groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("number", "repeated", "role", "text", "tokens"))).alias("turns")
    )

    def write(batches):
        for batch in batches:
            cols = [[] for _ in range(7)]
            for conv, window, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, loss, size = [], [], 0
                for t in turns:
                    full, a, b = turn_text(t["role"], t["text"])
                    if not t["repeated"] and t["role"] == "assistant":
                        loss.append({"start": size + a, "end": size + b})
                    out.append(full)
                    size += len(full)
                again = sum(t["repeated"] for t in turns)
                for c, v in zip(
                    cols,
                    (conv, window, sum(t["tokens"] for t in turns), turns[again]["number"], again, "".join(out), loss),
                    strict=True,
                ):
                    c.append(v)
            yield batch_of(_ARROW, cols)

    return parts.mapInArrow(write, WINDOWS)
