"""Chat formatting in budgeted windows, and reading the windows back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of the template and what stands for them inside a text.
CONTROLS = {"<s>": "\\1", "</s>": "\\2", "[INST]": "\\3", "[/INST]": "\\4"}
BACK = {"1": "<s>", "2": "</s>", "3": "[INST]", "4": "[/INST]", "n": "\n", "\\": "\\"}
TURN = re.compile(r"<s>([^\n]*)\n(?:\[INST\])?(.*?)(?:\[/INST\])?</s>", re.DOTALL)


def escape(text: str) -> str:
    """Replace backslashes and control strings; the result holds no control string."""
    text = text.replace("\\", "\\\\")
    for control, stand_in in CONTROLS.items():
        text = text.replace(control, stand_in)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m[1]], text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and where its text stands in it."""
    head = "<s>" + escape(role).replace("\n", "\\n") + "\n" + ("" if role == "assistant" else "[INST]")
    body = escape(text)
    return head + body + ("" if role == "assistant" else "[/INST]") + "</s>", len(head), len(head) + len(body)


def turn_tokens(rendered: str) -> int:
    """A turn's cost: four characters a token, rounded up."""
    return -(-len(rendered) // 4)


@dataclass
class _Turn:
    at: int  # number in the conversation
    role: str
    rendered: str
    start: int
    end: int
    before: int  # prefix sum: tokens of the turns before it

    @property
    def after(self) -> int:
        return self.before + turn_tokens(self.rendered)


@dataclass
class _Windows:
    """Cuts one conversation, turn by turn, into windows of at most `budget` tokens.

    A turn-aligned span from prefix sum a to b costs b - a. A window is the leading
    system turn, then at most `history` turns (and tokens) of the span before, as far as the
    budget has room beside the first new turn, then the new span. A turn too long for the
    budget with the system turn has a window of its own, whole.
    """

    budget: int
    history_turns: int
    history_tokens: int
    system: _Turn | None = None
    past: list[_Turn] = field(default_factory=list)
    fresh: list[_Turn] = field(default_factory=list)
    number: int = 0
    total: int = 0
    count: int = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        rendered, start, end = render(role, text)
        turn = _Turn(self.count, role, rendered, start, end, self.total)
        self.total, self.count = turn.after, self.count + 1
        if turn.at == 0 and role == "system":
            self.system = turn
        if self.fresh and turn.after - self._from() + self._fixed() > self.budget:
            yield self.close()
        if not self.fresh:
            kept = turn_tokens(self.system.rendered) if self.system is not None and self.system is not turn else 0
            while self.past and turn.after - self.past[0].before + kept > self.budget:
                self.past.pop(0)
        self.fresh.append(turn)

    def _from(self) -> int:
        return (self.past or self.fresh)[0].before

    def _fixed(self) -> int:
        kept = self.system is not None and self.system is not self.fresh[0]
        return turn_tokens(self.system.rendered) if kept else 0

    def close(self) -> tuple:
        """The window as a row; its last turns become the next one's history."""
        repeated = ([self.system] if self._fixed() else []) + self.past
        pieces, spans, at = [], [], 0
        for turn in [*repeated, *self.fresh]:
            pieces.append(turn.rendered)
            if turn.role == "assistant" and turn.at >= self.fresh[0].at:
                spans.append([at + turn.start, at + turn.end])
            at += len(turn.rendered)
        row = (self.number, self.fresh[0].at, len(repeated), len(self.fresh), "".join(pieces), spans)
        end = self.fresh[-1].after
        recent = [t for t in [*self.past, *self.fresh][-self.history_turns :] if t is not self.system] if self.history_turns else []
        self.past = [t for t in recent if end - t.before <= self.history_tokens]
        self.number, self.fresh = self.number + 1, []
        return row


def format_conversations(
    turns: DataFrame, budget: int = 512, history_turns: int = 2, history_tokens: int = 128,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Conversations as windows of formatted text with a loss mask.

    Returns conv_id, window, first_turn, repeated (leading turns that another window has
    as new), new_turns, formatted, loss (spans of code points). Only assistant texts that
    are new in a window are under the mask, so each is learnt once.

    Turns are read in order (turn, role, text) after one shuffle by conversation; a
    conversation streams through its task, which holds one window of it at a time,
    however long it is. Null role or text: empty. Null turns come first; rows with a null
    conv_id are one conversation. Repeated rows are turns of their own. Empty input: no
    rows. Other columns are not carried.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    narrow = turns.select(
        F.col(conv_col).cast("string").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    names = ["conv_id", "window", "first_turn", "repeated", "new_turns", "formatted", "loss"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = _NONE
        state = None
        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, *state.close()))
                    now, state = conv, _Windows(budget, history_turns, history_tokens)
                out += [(now, *w) for w in state.add(role, text)]
            if out:
                yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame([(now, *state.close())], columns=names)

    return (
        narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInPandas(run, "conv_id string, window long, first_turn long, repeated int, new_turns int, formatted string, loss array<array<int>>")
        .withColumn("conv_id", F.col("conv_id").cast(kind))
    )


_NONE = object()


def parse_window(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a window."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def read_windows(windows: DataFrame) -> DataFrame:
    """What the windows hold, per conversation: n_turns and digests of turns and of the loss text.

    Each turn counts in the window in which it is new. Streams like the formatter.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = _NONE
        turns = loss = None
        n = chars = formatted_chars = count = 0
        for batch in batches:
            out = []
            for conv, repeated, formatted, spans in zip(batch["conv_id"], batch["repeated"], batch["formatted"], batch["loss"], strict=True):
                if turns is None or conv != now:
                    if turns is not None:
                        out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars, count))
                    now, turns, loss, n, chars, formatted_chars, count = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                for role, text in parse_window(formatted)[repeated:]:
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for start, end in spans:
                    text = unescape(formatted[start:end])
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    chars += len(text)
                formatted_chars += len(formatted)
                count += 1
            if out:
                yield pd.DataFrame(out, columns=names)
        if turns is not None:
            yield pd.DataFrame([(now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars, count)], columns=names)

    return (
        windows.select(F.col("conv_id").cast("string"), "window", "repeated", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
        .mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
        .withColumn("conv_id", F.col("conv_id").cast(kind))
    )
