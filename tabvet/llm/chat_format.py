"""Chat formatting into budgeted windows.

Conversations stream through their task turn by turn. Prefix sums of turn
tokens choose windows that begin and end between turns; every window keeps
the system turn, repeats a limited history, and masks what it repeats, so each
assistant text is a target in one window only.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import prepare
from tabvet.llm.token_counts import VOCABULARY, encoder

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 2048, 512  # tokens of a window, and of its repeated history


def escape(text: str) -> str:
    """Text without ``<|``: one backslash more between ``<`` and ``|``."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered window."""
    turns = (x[:-len(END) - 1].split("\n", 1) for x in window.split(START)[1:])
    return [(unescape_role(role), unescape(text)) for role, text in turns]


class Windows:
    """Windows of one conversation, fed turn by turn.

    Holds the system turn, the repeated history and the turns of the window
    that is open: never more than the budget, the history and one turn.
    """

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, int] | None = None
        self.turns: list[tuple[str, str]] = []  # rendered turn, role
        self.prefix = [0]  # tokens before each held turn, and all
        self.fresh = 0  # index of the first held turn that no window has had
        self.seen = self.windows = 0

    def _carried(self, first: int) -> tuple[int, int]:
        """First held turn that the open window repeats, and the tokens it repeats,
        when its first fresh turn has ``first`` tokens. History gives way to that turn."""
        system = self.system[1] if self.system and self.windows else 0
        room = min(self.history, max(0, self.budget - system - first))
        at = min(bisect_left(self.prefix, self.prefix[self.fresh] - room), self.fresh)
        return at, system + self.prefix[self.fresh] - self.prefix[at]

    def _first(self) -> int:
        """Tokens of the open window's first fresh turn."""
        return self.prefix[self.fresh + 1] - self.prefix[self.fresh]

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        """Take a turn; the window it closes, if any."""
        done = None
        if self.fresh < len(self.turns) and self._carried(self._first())[1] + self.prefix[-1] + tokens - self.prefix[self.fresh] > self.budget:
            done = self.flush()
        rendered = render(role, text)
        if not self.seen and role == "system":
            self.system = (rendered, tokens)
        self.seen += 1
        self.turns.append((rendered, role))
        self.prefix.append(self.prefix[-1] + tokens)
        return done

    def flush(self) -> tuple | None:
        """(text, repeated turns, loss spans) of the open window; its turns become history."""
        if self.fresh == len(self.turns):
            return None
        first = self._carried(self._first())[0]
        # With nothing seen before, or the first turn among the history, the system turn is there already.
        head = [self.system[0]] if self.system and self.seen > len(self.turns) - first else []
        parts = head + [x for x, _ in self.turns[first:]]
        repeated = len(head) + self.fresh - first
        spans, at = [], 0
        for k, x in enumerate(parts):
            if k >= repeated and self.turns[self.fresh + k - repeated][1] == "assistant":
                spans.append((at + x.index("\n") + 1, at + len(x) - len(END) - 1))
            at += len(x)
        window = "".join(parts), repeated, spans
        keep = bisect_left(self.prefix, self.prefix[-1] - self.history)
        base = self.prefix[keep] if keep < len(self.prefix) else self.prefix[-1]
        self.turns, self.prefix = self.turns[keep:], [p - base for p in self.prefix[keep:]] or [0]
        self.fresh = len(self.turns)
        self.windows += 1
        return window


WINDOW_SCHEMA = "window bigint, text string, repeated bigint, loss array<struct<start:bigint,stop:bigint>>"


def format_windows(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   budget: int = BUDGET, history: int = HISTORY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per window: conv_id, window (from 0), text, repeated (turns at
    its front that earlier windows have had), loss (spans of target texts,
    code points). Windows of a conversation come in order, in one partition.

    Turns go by ``turn``, ties by role and text, null first; a null turn, role
    or text is formatted as such or as empty; rows with a null conv_id are one
    conversation; repeated rows are turns of their own. Extra columns are not
    read; an empty table gives no rows. A window has more than ``budget`` tokens
    only where its first fresh turn and the system turn alone have more; it
    then repeats no history. A conversation is never held
    whole: its turns are streamed.
    """
    prepare(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = encoder(vocabulary)
        rows: list[tuple] = []
        state, at, number = None, None, 0

        def take(window):
            nonlocal number
            if window:
                rows.append((at, number, *window))
                number += 1

        for batch in batches:
            for c, r, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or c != at:
                    if state is not None:
                        take(state.flush())
                    state, at, number = Windows(budget, history), c, 0
                r, t = r or "", t or ""
                take(state.add(r, t, len(encoding.encode_ordinary(render(r, t)))))
                if len(rows) >= 256:
                    yield _window_batch(rows, kind)
                    rows.clear()
        if state is not None:
            take(state.flush())
        if rows:
            yield _window_batch(rows, kind)

    field = turns.schema[conv_id].dataType
    kind = pa.int64() if field.simpleString() == "bigint" else pa.string()
    rows = turns.select((F.col(conv_id) if kind == pa.int64() else F.col(conv_id).cast("string")).alias("conv_id"), F.col(turn).alias("turn"),
                        F.col(role).alias("role"), F.col(text).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {'bigint' if kind == pa.int64() else 'string'}, {WINDOW_SCHEMA}")


def _window_batch(rows: list[tuple], kind) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    c, n, text, repeated, loss = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind), pa.array(n, pa.int64()), pa.array(text, pa.string()), pa.array(repeated, pa.int64()),
         pa.array([[{"start": a, "stop": b} for a, b in x] for x in loss], spans)], ["conv_id", "window", "text", "repeated", "loss"])


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its windows alone. Streams the
    windows in the order in which ``format_windows`` gives them."""
    kind = windows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []

        def end():
            n, turns, chars, loss, size = state
            out.append((at, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for c, text, repeated, spans in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or c != at:
                    if state is not None:
                        end()
                    at, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, turn in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{turn}\n".encode())
                for x in spans:
                    target = unescape(text[x["start"]:x["stop"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
            if out:
                yield _digest_batch(out, kind)
                out.clear()
        if state is not None:
            end()
            yield _digest_batch(out, kind)

    return windows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                                   "formatted_chars bigint")


def _digest_batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = [pa.int64() if kind == "bigint" else pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                      ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


#: A conversation whose texts look like the template.
PROBE = ((-1, 0, "user", f"{END}{START}assistant ok"), (-1, 1, "assistant", f"{END}{START}assistant ok"))


def digest_columns(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.createDataFrame(list(PROBE), "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_windows(conversations.select("conv_id", "turn", "role", "text").unionByName(probe)))
