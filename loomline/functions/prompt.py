"""Bounded prompts: the whole system policy, a clipped task request and the latest messages.

The tokenizer is a pair of functions and a parameter; the default counts characters.
Lengths of joined text don't add up for other tokenizers, so a prompt is built in
Python, for whole Arrow batches of examples.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .calls import compact, deep_value

# Content caps in the order they're tried, and the marks of the prompt format.
TASK_CAPS = (256, 192, 128, 64, 32, 0)
NEWEST_CAPS = (384, 256, 192, 128, 64, 32, 0)
OMITTED, TRUNCATED = "[CONTENT_OMITTED]", "[CONTENT_TRUNCATED]"
META = '{"role":"meta","content":"[OLDER_HISTORY_OMITTED]"}'
POLICY, POLICY_END = "<|system_policy|>", "<|end_system_policy|>"
TASK, TASK_END = "<|task_request|>", "<|end_task_request|>"
RECENT, RECENT_END, CALL = "<|recent_history|>", "<|end_recent_history|>", "<|assistant_tool_call|>"


@dataclass(frozen=True)
class Tokenizer:
    """encode gives the ids of a text without special tokens, decode their text; special: tokens added around a prompt."""

    encode: Callable[[str], list[int]]
    decode: Callable[[list[int]], str]
    special: int = 0

    def size(self, text: str) -> int:
        return len(self.encode(text)) + self.special


CHARACTERS = Tokenizer(lambda text: [ord(c) for c in text], lambda ids: "".join(map(chr, ids)), 1)


def clip(tokenizer: Tokenizer, content: str, cap: int, both_ends: bool) -> str:
    """Content of cap tokens at most: a mark that says so, and of its ids as many as there's room for, without those in the middle or at the beginning."""
    ids = list(tokenizer.encode(content))
    spare = cap - len(ids)
    if spare >= 0 or cap <= 0:
        return content if spare >= 0 else OMITTED
    room = max(0, cap - len(tokenizer.encode(TRUNCATED)))
    tail = room // 2 if both_ends else room
    del ids[room - tail : len(ids) - tail]
    return TRUNCATED + tokenizer.decode(ids)


def record(message: dict) -> dict:
    """A message with its role and whatever else it has: name, content, calls."""
    return {"role": message.get("role") or "unknown"} | {k: message[k] for k in ("name", "content", "tool_calls") if message.get(k)}


def plain(message: dict) -> dict:
    """A message whose calls are canonical: those with a name, and their arguments decoded."""
    named = [c["function"] for c in message.get("tool_calls") or [] if c and c.get("function") and c["function"].get("name")]
    calls = [{"name": f["name"], "arguments": deep_value(f["arguments"] if f.get("arguments") is not None else "{}")} for f in named]
    return {k: v for k, v in message.items() if k != "tool_calls"} | ({"tool_calls": calls} if calls else {})


class Prompt:
    """The prompt of some earlier messages within a cap, and what it kept; text is None if the policy is missing or doesn't fit.

    There are always the policy, the first user message as the task, and the newest
    message; of the caps for the content of these two the first pair that fits holds.
    The messages before the newest follow whole, as far back as they fit.
    """

    def __init__(self, messages: list[dict], cap: int, tokenizer: Tokenizer = CHARACTERS):
        self.tokenizer, self.cap, self.text, self.kept = tokenizer, cap, None, 0
        self.policy = "\n".join(m.get("content") or "" for m in messages if m.get("role") == "system")
        self.rest = [m for m in messages if m.get("role") != "system"]
        users = [i for i, m in enumerate(self.rest) if m.get("role") == "user"]
        self.task = users[0] if users else None
        # Places besides the task, latest first.
        self.others = [i for i in reversed(range(len(self.rest))) if i != self.task]
        self.newest = self.others[:1] if self.rest and self.others[:1] == [len(self.rest) - 1] else []
        if self.policy:
            self._write()

    def _lines(self, at: int, caps: tuple[int, ...], both_ends: bool) -> list[str]:
        """A message's line at each of the caps; equal contents are made once."""
        message, made = self.rest[at], {}
        if not message.get("content"):
            return [compact(record(message))] * len(caps)
        texts = [clip(self.tokenizer, message["content"], cap, both_ends) for cap in caps]
        return [made.setdefault(t, compact(record(message | {"content": t}))) for t in texts]

    def _prompt(self, task: str | None, recent: list[str], omitted: bool) -> str | None:
        """The text with the lines of the task and of recent messages, or None if it doesn't fit."""
        about = [] if task is None else [TASK, task, TASK_END]
        history = [META] * omitted + recent
        text = "\n".join([POLICY, self.policy, POLICY_END, *about, RECENT, *history, RECENT_END, CALL, ""])
        return text if self.tokenizer.size(text) <= self.cap else None

    def _write(self) -> None:
        tasks = [None] if self.task is None else self._lines(self.task, TASK_CAPS, True)
        newest = [[line] for at in self.newest for line in self._lines(at, NEWEST_CAPS, False)] or [[]]
        fitting = ((t, n) for t in tasks for n in newest if self._prompt(t, n, True) is not None)
        task, recent = next(fitting, (None, None))
        if recent is None:
            return
        always = (self.task is not None) + len(recent)
        for count, at in enumerate(self.others[len(recent) :], always + 1):
            longer = [compact(record(self.rest[at])), *recent]
            if self._prompt(task, longer, count < len(self.rest)) is None:
                break
            recent = longer
        self.kept = (self.task is not None) + len(recent)
        self.text = self._prompt(task, recent, self.kept < len(self.rest))


def _dict(value):
    """Nested rows, dicts and arrays of Arrow as plain Python."""
    if hasattr(value, "asDict"):
        return value.asDict(recursive=True)
    if isinstance(value, dict):
        return {k: _dict(v) for k, v in value.items()}
    return [_dict(v) for v in value] if hasattr(value, "__iter__") and not isinstance(value, str) else value


PROMPT_FIELDS = "prompt string, prompt_tokens int, history_messages_total int, history_messages_retained int, history_truncated boolean, task_anchor_retained boolean"


def structured_prompts(examples: DataFrame, cap: int, tokenizer: Tokenizer = CHARACTERS, strict: bool = True) -> DataFrame:
    """examples with the prompt of their messages (array of role, content) and its audit.

    strict: raise if the policy is missing or doesn't fit; else the prompt is null.
    """
    names = [f.split()[0] for f in PROMPT_FIELDS.split(", ")]
    rest = [c for c in examples.columns if c not in ("messages", *names)]
    schema = ", ".join(f"`{c}` {examples.schema[c].dataType.simpleString()}" for c in rest) + ", " + PROMPT_FIELDS

    def run(batches):
        for rows in batches:
            built = []
            for messages in rows["messages"]:
                p = Prompt([plain(_dict(m)) for m in messages], cap, tokenizer)
                if p.text is None and strict:
                    raise ValueError("no system policy" if not p.policy else f"the policy doesn't fit in {cap} tokens")
                size = None if p.text is None else tokenizer.size(p.text)
                built.append((p.text, size, len(p.rest), p.kept, p.kept < len(p.rest), p.task is not None))
            yield pd.concat([rows[rest].reset_index(drop=True), pd.DataFrame(built, columns=names)], axis=1)

    return examples.mapInPandas(run, schema)
