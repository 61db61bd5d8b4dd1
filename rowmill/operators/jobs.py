"""Ready-made jobs around a text client: completion, chat, several choices, perplexity, multi-turn, translation."""

from __future__ import annotations

import math
from typing import Any, Protocol

from rowmill.operators.transform import RowJob

MESSAGES = "array<struct<role:string,content:string,reasoning_content:string>>"


class Client(Protocol):
    """A reply: dict with ``content`` and, where known, ``reasoning_content`` and ``logprobs`` (list of numbers)."""

    def reply(self, messages: list[dict], n: int = 1) -> list[dict]: ...


class EchoClient:
    """Deterministic, for tests: repeats the last message's content with its place among ``n`` choices."""

    def reply(self, messages: list[dict], n: int = 1) -> list[dict]:
        text = (messages[-1].get("content") or "") if messages else ""
        return [{"content": f"echo{i}:{text}" if n > 1 else f"echo:{text}", "logprobs": [-float(len(w)) / 8 for w in text.split(" ") if w]} for i in range(1, n + 1)]


def as_messages(item: Any) -> list[dict]:
    if item is None:
        return []
    return [{"role": "user", "content": item}] if isinstance(item, str) else [dict(m) for m in item]


def perplexity(logprobs: list[float]) -> float:
    return math.exp(-sum(logprobs) / len(logprobs)) if logprobs else math.inf


class ClientJob(RowJob):
    """``client`` must be given: nothing answers in its place."""

    def __init__(self, client: Client, **settings: Any):
        super().__init__(**settings)
        self.client = client

    def one(self, item: Any) -> Any:
        raise NotImplementedError

    def transform_items(self, items: list[Any]) -> list[Any]:
        return [self.one(x) for x in items]


class CompletionJob(ClientJob):
    schema = "completion string"

    def __init__(self, client: Client, **settings: Any):
        super().__init__(client, **({"input_column": "prompt"} | settings))

    def one(self, item: str) -> str:
        return self.client.reply(as_messages(item))[0]["content"]


class ChatJob(ClientJob):
    """Content, and the reasoning in a second column if ``reasoning`` is asked for."""

    def __init__(self, client: Client, reasoning: bool = False, **settings: Any):
        super().__init__(client, **settings)
        self.reasoning = reasoning
        self.schema = "result string, reasoning_content string" if reasoning else "result string"

    def one(self, item: Any) -> Any:
        got = self.client.reply(as_messages(item))[0]
        return (got["content"], got.get("reasoning_content")) if self.reasoning else got["content"]


class ChoicesJob(ClientJob):
    """``n`` choices in columns ``<base>_1`` to ``<base>_n``."""

    def __init__(self, client: Client, n: int = 3, base: str = "result", **settings: Any):
        super().__init__(client, **settings)
        self.n, self.schema = n, ", ".join(f"{base}_{i} string" for i in range(1, n + 1))

    def one(self, item: Any) -> Any:
        got = tuple(x["content"] for x in self.client.reply(as_messages(item), self.n))
        return got if self.n > 1 else got[0]


class PerplexityJob(ClientJob):
    schema = "text string, perplexity double, bottom50_perplexity double"

    def one(self, item: Any) -> tuple:
        got = self.client.reply(as_messages(item))[0]
        logs = [x for x in got.get("logprobs") or [] if x is not None]
        return got["content"], perplexity(logs), perplexity(sorted(logs)[:50])


class MultiTurnJob(ClientJob):
    """Replays a conversation: at each user or tool turn the history so far gets a reply.

    The turn after each answered one is taken for the recorded answer and passed over, also where it
    is another user turn, which is then answered a second time; ``strict`` answers only turns that
    stay in the history. Turns after the last answered one are left out.
    """

    schema = f"running_messages {MESSAGES}"

    def __init__(self, client: Client, strict: bool = False, **settings: Any):
        super().__init__(client, **settings)
        self.strict = strict

    def one(self, item: Any) -> list[dict]:
        given, history, at, replies = as_messages(item), [], 0, 0
        asked = [i for i, m in enumerate(given) if m["role"] in ("user", "tool")]
        if not asked:
            raise ValueError("the conversation has no user or tool turn")
        for i in asked:
            if self.strict and i < at:
                continue
            history += given[at : i + 1]
            got = self.client.reply(history)[0]
            history.append({"role": "assistant", "content": got["content"], "reasoning_content": got.get("reasoning_content")})
            at, replies = i + 2, replies + 1
        return [{k: m.get(k) for k in ("role", "content", "reasoning_content")} for m in history]


class TranslationJob(ClientJob):
    """Message 0 is the instruction; every later message is sent with it alone, and keeps its role."""

    schema = f"results {MESSAGES}"

    def one(self, item: Any) -> list[dict]:
        system, *rest = as_messages(item)
        out = []
        for m in rest:
            got = self.client.reply([system, {"role": "user", "content": m["content"]}])[0]
            out.append({"role": m["role"], "content": got["content"], "reasoning_content": got.get("reasoning_content")})
        return out
