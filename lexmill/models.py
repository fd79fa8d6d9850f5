"""Seams for models, and deterministic stand-ins for tests.

The engine never loads a neural model itself: an embedder, reranker, tokenizer,
recogniser, heading detector or language model is a callable that is passed in.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from typing import Protocol


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def __call__(self, messages: list[dict[str, str]]) -> str: ...


class Reranker(Protocol):
    """Scores between 0 and 1 of (question, passage) pairs; ``activated`` makes one of a model that gives logits."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def activated(logits: Callable[[list[tuple[str, str]]], list[float]]) -> Reranker:
    """A cross-encoder's logits as scores (sigmoid)."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        return [1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x)) for x in logits(pairs)]

    return score


class OverlapReranker:
    """A stand-in: the share of the question's distinct letters and digits that a passage holds."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for question, passage in pairs:
            asked = {c for c in question.lower() if c.isalnum()}
            held = passage.lower()
            out.append(sum(c in held for c in asked) / max(1, len(asked)))
        return out


def token_rate(tokens: int, seconds: float) -> float | None:
    """Tokens a second of an answer; None if no time is known."""
    return round(tokens / seconds, 4) if seconds > 0 else None


_LOADED: dict[str, Callable] = {}


class PerWorker:
    """A model that every worker loads once, when it first needs it.

    What travels with the tasks is ``load`` (a function or class that can be
    pickled) and a name; models of one name are one.
    """

    def __init__(self, name: str, load: Callable[[], Callable]) -> None:
        self.name, self.load = name, load

    def __call__(self, *args: object) -> object:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name](*args)


class HashEmbedder:
    """Unit vectors from hashed character bigrams."""

    def __init__(self, dimension: int = 32) -> None:
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = [0.0] * self.dimension
        padded = f" {text.lower()} "
        for i in range(len(padded) - 1):
            h = int.from_bytes(hashlib.blake2b(padded[i : i + 2].encode(), digest_size=4).digest(), "big")
            v[h % self.dimension] += 1.0 if h >> 16 & 1 else -1.0
        length = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / length for x in v] if any(v) else [1.0] + [0.0] * (self.dimension - 1)


def echo_generator(messages: list[dict[str, str]]) -> str:
    """Answers with the first cited line of the last message, or refuses."""
    for line in messages[-1]["content"].splitlines():
        if line.startswith("[S"):
            return line.split("] ", 1)[-1] + " " + line.split("]", 1)[0] + "]"
    return "文件內容不足以回答這個問題"


def rule_headings(numbered: str) -> list[dict[str, object]]:
    """A heading detector by rule: short lines without end punctuation."""
    out = []
    for row in numbered.splitlines():
        number, _, line = row.partition("| ")
        if line and len(line) <= 24 and line[-1] not in "。．.：:；;，,":
            out.append({"start_line": int(number), "level": 1, "title": line})
    return out


def answered(generate: Callable[[list[dict[str, str]]], str], messages: list[dict[str, str]]) -> str:
    """The generator's answer; an error if it isn't a text or blank."""
    answer = generate(messages)
    if not isinstance(answer, str) or not answer.strip():
        raise ValueError("the generator must return a text that isn't blank")
    return answer.strip()


def room_for_answer(context: int, prompt_tokens: int, wanted: int, reserve: int = 16, least: int = 64) -> int:
    """Tokens an answer may have; an error if fewer than ``least`` remain."""
    room = context - prompt_tokens - reserve
    if room < least:
        raise ValueError("the prompt leaves too little room for an answer")
    return min(room, wanted)


class AnswerStream:
    """Splits a model's stream of text into reasoning and answer as it comes.

    The first ``probe`` characters are held back until it is clear whether the
    stream begins with reasoning; an end mark that comes in pieces is recognised.
    """

    OPEN, CLOSE = "<think>", "</think>"

    def __init__(self, thinking: bool = False, probe: int = 32) -> None:
        self.state = "reasoning" if thinking else "probe"
        self.probe, self.held, self.begun = probe, "", False

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """What may be shown now, as (``reasoning`` or ``answer``, text)."""
        self.held += piece
        out: list[tuple[str, str]] = []
        if self.state == "probe":
            start = self.held.lstrip()
            if start.startswith(self.OPEN):
                self.state, self.held = "reasoning", start[len(self.OPEN) :]
            elif len(self.held) >= self.probe or not self.OPEN.startswith(start[: len(self.OPEN)]):
                self.state = "answer"
        if self.state == "reasoning":
            before, mark, after = self.held.partition(self.CLOSE)
            if mark:
                self.state, self.held = "answer", after
            else:
                part = next((n for n in range(len(self.CLOSE) - 1, 0, -1) if before.endswith(self.CLOSE[:n])), 0)
                before, self.held = before[: len(before) - part], before[len(before) - part :]
            out += [("reasoning", before)] * bool(before)
        if self.state == "answer":
            shown = self.held if self.begun else self.held.lstrip()
            self.held, self.begun = "", self.begun or bool(shown)
            out += [("answer", shown)] * bool(shown)
        return out

    def close(self) -> list[tuple[str, str]]:
        """What was still held back."""
        kind = "reasoning" if self.state == "reasoning" else "answer"
        out, self.held = [(kind, self.held)] * bool(self.held), ""
        return out
