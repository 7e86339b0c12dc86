"""Chat formatting in budgeted windows.

A conversation becomes one or more training windows. Running sums of its turns'
token counts choose the spans: a window takes as many new turns as fit the budget
after the system turn, which every window repeats, and after up to `history`
turns repeated from before as far as they fit too. Spans start and end at turns;
a turn that exceeds the budget alone stays whole in a window of its own. Only
assistant texts that are new in a window are targets: the loss mask covers each
assistant text exactly once over all windows and never a repeated turn.

A turn is written as <|turn ROLE|>, a line feed, its text, <|end|>, a line feed.
Control strings inside a role or a text (these marks, <s>, </s>, [INST], [/INST],
<<SYS>>, <</SYS>>) get a backslash after their first character, and backslashes
are doubled, which unescape() reverses exactly.

Conversations stream through tasks sorted by (conversation, turn): a task holds
the turns of one window and a bounded history, never a whole conversation.

Defined cases: a null role or text is empty; null turns come last; turns that tie
are ordered by role, then text; repeated rows are turns of their own; rows with a
null conversation id form one conversation; a conversation without assistant
turns has windows without targets; a second system turn is an ordinary turn; an
empty table gives no windows. Columns besides the four are not looked at, whatever
their names.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = re.compile(r"\\|<(?=\||/?s>|</?SYS>>)|\|(?=>)|\[(?=/?INST\])")
ESCAPED = re.compile(r"\\\\|(?<=[<\[|])\\")
TURN = re.compile(r"<\|turn (.*?)\|>\n(.*?)<\|end\|>\n", re.S)
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" if m[0] == "\\\\" else "", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text starts and ends in it."""
    head, body = f"<|turn {escape(role)}|>\n", escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def token_counter(vocabulary: bytes | None) -> Callable[[str], int]:
    """Counts tokens with a byte-pair vocabulary (the contents of a file of ranks); without one, UTF-8 bytes over four, rounded up."""
    if vocabulary is None:
        return lambda text: -(-len(text.encode()) // 4)
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encoding = tiktoken.Encoding("chat", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


@dataclass
class _Turn:
    text: str
    body: tuple[int, int]
    tokens: int
    target: bool


class Windower:
    """Turns of one conversation in, its windows out."""

    def __init__(self, budget: int, history: int, count: Callable[[str], int]):
        self.budget, self.history, self.count = budget, history, count
        self.system: _Turn | None = None
        self.past: deque[_Turn] = deque(maxlen=max(history, 0))
        self.new: list[_Turn] = []
        self.sum = self.number = 0  # the sum: of the system turn and the new turns
        self.first = True

    def add(self, role: str, text: str) -> Iterator[dict]:
        written, a, b = write_turn(role, text)
        turn = _Turn(written, (a, b), self.count(written), role == "assistant")
        if self.new and self.sum + turn.tokens > self.budget:
            yield self._window()
        self.new.append(turn)
        self.sum += turn.tokens
        if self.first and role == "system":
            self.system = turn
        self.first = False

    def _window(self) -> dict:
        repeated = [self.system] if self.system and self.number else []
        room, back = self.budget - self.sum, []
        for turn in reversed(self.past):
            if turn.tokens > room:
                break
            room -= turn.tokens
            back.append(turn)
        repeated += reversed(back)
        at, targets, turns = 0, [], [*repeated, *self.new]
        for i, turn in enumerate(turns):
            if i >= len(repeated) and turn.target:
                targets.append((at + turn.body[0], at + turn.body[1]))
            at += len(turn.text)
        out = {"window": self.number, "text": "".join(t.text for t in turns), "n_repeated": len(repeated), "n_new": len(self.new), "n_tokens": sum(t.tokens for t in turns), "targets": [{"start": a, "end": b} for a, b in targets]}
        self.past.extend(t for t in self.new if t is not self.system)
        self.new, self.number = [], self.number + 1
        self.sum = self.system.tokens if self.system else 0
        return out

    def close(self) -> Iterator[dict]:
        if self.new:
            yield self._window()


WINDOWS = "window long, text string, n_repeated int, n_new int, n_tokens long, targets array<struct<start: long, end: long>>"
_TARGETS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_KINDS = {"window": pa.int64(), "text": pa.string(), "n_repeated": pa.int32(), "n_new": pa.int32(), "n_tokens": pa.int64(), "targets": _TARGETS}


def format_windows(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 1024, history: int = 2, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """One row per window: conv_id and WINDOWS. Windows of a conversation come in order, within one partition."""
    own = conversations.select(F.col(conv_id).cast("long").alias(conv_id), F.col(turn).alias("turn_"), F.coalesce(role, F.lit("")).alias("role_"), F.coalesce(text, F.lit("")).alias("text_"))
    own = own.repartition(conv_id).sortWithinPartitions(F.col(conv_id), F.col("turn_").asc_nulls_last(), "role_", "text_")

    vocabulary = None
    if tokenizer is not None:  # read here and sent along: a megabyte or so, and executors need no file
        with open(tokenizer, "rb") as f:
            vocabulary = f.read()
    shared = conversations.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, now, current, rows, size = token_counter(shared.value), (), None, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, size
            out = pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), *(pa.array([w[k] for _, w in rows], t) for k, t in _KINDS.items())], [conv_id, *_KINDS])
            rows, size = [], 0
            return out

        for batch in batches:
            for conv, r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if (conv,) != now:
                    if current:
                        rows += [(*now, w) for w in current.close()]
                    now, current = (conv,), Windower(budget, history, count)
                for w in current.add(r, t):
                    rows.append((conv, w))
                    size += len(w["text"])
                if size > 8 << 20:
                    yield flush()
            yield flush()
        if current:
            rows += [(*now, w) for w in current.close()]
        yield flush()

    return own.mapInArrow(run, f"{conv_id} long, {WINDOWS}")


def read_turns(window: str) -> list[tuple[str, str]]:
    """Role and text of every turn written in a window."""
    out, at = [], 0
    for m in TURN.finditer(window):
        if m.start() != at:
            raise ValueError("text outside of turns")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(window):
        raise ValueError("text outside of turns")
    return out
