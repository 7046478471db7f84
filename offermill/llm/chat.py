r"""Chat formatting in budgeted windows.

A conversation's turns are weighed in tokens; running sums cut it into spans of whole turns.  Every window shows the
system turn, as much recent history as fits, and its own span.  The loss mask covers the assistant texts of the span
alone, so a turn that a later window repeats is a target once.

Marks: ``<|im_start|>role\n`` text ``<|im_end|>\n``.  Inside roles and texts every ``<|`` is written ``<\|`` and every
run of backslashes between ``<`` and ``|`` grows by one, which can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET = 1024
HISTORY = 256
TRAINED = "assistant"
SYSTEM = "system"

_TO_GUARD = re.compile(r"<(\\*)\|")
_GUARDED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def guard(text: str) -> str:
    return _TO_GUARD.sub(r"<\\\1|", text)


def unguard(text: str) -> str:
    return _GUARDED.sub(r"<\1|", text)


def formatted_turn(role: str, text: str) -> str:
    return f"{START}{guard(role).replace('\n', '<|nl|>')}\n{guard(text)}{END}\n"


def token_count(role: Column, text: Column) -> Column:
    """The default weight of a turn: its words and symbols, and four for the marks."""
    return (F.regexp_count(F.concat_ws(" ", role, text), F.lit(r"\w+|[^\w\s]")) + 4).cast("long")


class _Window:
    """Turns of one window: (role, text, is_target, is_context)."""

    def __init__(self, system: list, history: list):
        self.turns = [*((*t, False) for t in system), *((*t, False) for t in history)]
        self.context = len(self.turns)

    def render(self) -> tuple[str, list[int], list[int]]:
        out, at, starts, ends = [], 0, [], []
        for role, text, target in self.turns:
            block = formatted_turn(role, text)
            if target:
                starts.append(at + block.index("\n") + 1)
                ends.append(at + len(block) - len(END) - 1)
            out.append(block)
            at += len(block)
        return "".join(out), starts, ends


def _windows_of(turns: Iterator[tuple], budget: int, history: int, trained: str) -> Iterator[tuple]:
    """Windows of one conversation, whose turns arrive in order as (role, text, tokens).

    Only the current span and the history that may be repeated are held.
    """
    system: list = []
    system_tokens = 0
    recent: list = []  # turns that a next window may repeat
    span: list = []
    used = context = 0
    number = 0

    def close():
        nonlocal number
        window = _Window(system if number else [], [(r, t) for r, t, _ in context_turns])
        window.turns += [(r, t, r == trained) for r, t, _ in span]
        row = (number, window.context, len(span), *window.render())
        number += 1
        return row

    context_turns: list = []
    for role, text, tokens in turns:
        if span and context + used + tokens > budget:
            yield close()
            keep, total = [], 0
            room = min(history, max(0, budget - system_tokens - tokens))
            for turn in reversed(recent + span[1 if system and number == 1 else 0:]):
                if total + turn[2] > room:
                    break
                keep.append(turn)
                total += turn[2]
            context_turns = keep[::-1]
            recent = context_turns
            span, used, context = [], 0, system_tokens + total
        if role == SYSTEM and not number and not span and not system:
            system, system_tokens = [(role, text)], tokens
            span.append((role, text, tokens))
            used += tokens
            continue
        span.append((role, text, tokens))
        used += tokens
    if span:
        yield close()


FORMATTED = "conv_id long, window long, context_turns long, span_turns long, formatted string, loss_start array<int>, loss_end array<int>"


def formatted(
    conversations: DataFrame, *, tokens: Column | None = None, budget: int = BUDGET, history: int = HISTORY, trained: str = TRAINED
) -> DataFrame:
    """Windows of every conversation: conv_id, window, context_turns, span_turns, formatted, loss_start, loss_end.

    ``loss_start``/``loss_end`` are code point ranges of ``formatted``.  A turn above the budget fills a window of its
    own and is never cut.  The first turn counts as the system turn if its role says so; later system turns are
    ordinary.  Null roles and texts are empty; a null conv_id is a conversation; rows of one turn number run in the
    order of role and text, repeated rows stay repeated turns.  An empty table gives no rows.

    A task streams its conversations turn by turn out of the sorted partition and holds one window of each.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    weight = token_count(role, text) if tokens is None else tokens
    rows = (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), weight.alias("tokens"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text", "tokens")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stream():
            for frame in frames:
                ids = [None if pd.isna(i) else int(i) for i in frame["conv_id"]]
                yield from zip(ids, frame["role"], frame["text"], frame["tokens"])

        flow = stream()
        ahead = next(flow, None)

        def turns_of(conv):
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield ahead[1:]
                ahead = next(flow, None)

        ready, size = [], 0
        while ahead is not None:
            conv = ahead[0]
            for window in _windows_of(turns_of(conv), budget, history, trained):
                ready.append((conv, *window))
                size += len(window[3])
                if size > 4 << 20:
                    yield _frame(ready)
                    ready, size = [], 0
        if ready:
            yield _frame(ready)

    return rows.mapInPandas(run, FORMATTED)


def _frame(rows: list) -> pd.DataFrame:
    names = ["conv_id", "window", "context_turns", "span_turns", "formatted", "loss_start", "loss_end"]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"conv_id": "Int64"})


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    return [(unguard(r.replace("<|nl|>", "\n")), unguard(t)) for r, t in _TURN.findall(text)]


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Context turns are skipped, spans put together in order; digests are updated window by window.
    """
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        done = []

        def finish():
            conv, n, all_turns, loss_chars, loss, chars = state
            done.append((conv, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for frame in frames:
            for conv, context, text, starts, ends in zip(
                frame["conv_id"], frame["context_turns"], frame["formatted"], frame["loss_start"], frame["loss_end"]
            ):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or state[0] != conv:
                    if state is not None:
                        finish()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[int(context):]:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                for lo, hi in zip(starts, ends):
                    target = unguard(text[lo:hi])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
            if len(done) > 10_000:
                yield _digests(done)
                done.clear()
        if state is not None:
            finish()
        if done:
            yield _digests(done)

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInPandas(run, kinds)


def _digests(rows: list) -> pd.DataFrame:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
