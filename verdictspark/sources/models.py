"""Connector to served models: prompts as a DataFrame in, long rows of answers and of usage out.

The caller gives a function that answers one request: `chat` asks a server, tests and
offline runs replay recorded answers. Requests of a task run on a small pool; order is kept by
key. One pass gives both streams, told apart by `kind`, so that usage is data like any other.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns behind the key: kind is 'sample' (sample, raw) or 'usage' (the others).
ANSWERS = "kind string, sample int, raw string, prompt_tokens long, completion_tokens long, n int, finish_reasons array<string>"
_COLUMNS = [c.split()[0] for c in ANSWERS.split(", ")]


class Unanswered(RuntimeError):
    """No attempt at a request brought an answer."""


@dataclass(frozen=True)
class Endpoint:
    label: str
    model: str
    base_url: str

    @classmethod
    def parse(cls, text: str) -> Endpoint:
        """label=model@url, or ValueError."""
        label, eq, rest = text.partition("=")
        model, at, url = rest.rpartition("@")
        if not (eq and at and label and model and url):
            raise ValueError(f"{text!r} names no endpoint: a label, '=', a model, '@' and a URL")
        return cls(label, model, url)

    @property
    def chat_url(self) -> str:
        """The chat route; the API's version may be part of base_url or not."""
        base = self.base_url.rstrip("/")
        return f"{base}/chat/completions" if base.endswith("/v1") else f"{base}/v1/chat/completions"


@dataclass(frozen=True)
class Reply:
    """Texts of a request's choices, and what the server counted."""

    texts: list[str | None]
    usage: dict | None = field(default=None)


Answer = Callable[[Endpoint, list[dict], int], "Reply | list[str | None]"]


def payload(endpoint: Endpoint, turns: list[dict], samples: int, temperature: float, max_tokens: int, schema: dict | None = None, seed: int | None = None, thinking: bool | None = None) -> dict:
    """The body of a chat request; what isn't asked for isn't sent."""
    body: dict = {"model": endpoint.model, "messages": turns, "n": samples, "temperature": temperature, "max_tokens": max_tokens}
    if schema is not None:
        body["response_format"] = {"type": "json_schema", "json_schema": {"name": "audit", "schema": schema, "strict": True}}
    if seed is not None:
        body["seed"] = seed
    if thinking is not None:
        body["chat_template_kwargs"] = {"enable_thinking": thinking}
    return body


def usage_of(reply: dict, asked: int) -> dict | None:
    """Token counts of a reply, the choices asked for, and why each ended; None where the server counts nothing."""
    use = reply.get("usage")
    if not use:
        return None
    return {"prompt_tokens": use.get("prompt_tokens"), "completion_tokens": use.get("completion_tokens"), "n": asked, "finish_reasons": [c.get("finish_reason") for c in reply.get("choices", [])]}


def chat(temperature: float, max_tokens: int, schema: dict | None = None, seed: int | None = None, thinking: bool | None = None, timeout: float = 600.0) -> Answer:
    """An `answer` for generate that posts to the endpoint's chat route, past any proxy."""

    def answer(endpoint: Endpoint, turns: list[dict], samples: int) -> Reply:
        body = json.dumps(payload(endpoint, turns, samples, temperature, max_tokens, schema, seed, thinking)).encode()
        request = urllib.request.Request(endpoint.chat_url, body, {"Content-Type": "application/json"})
        with urllib.request.build_opener(urllib.request.ProxyHandler({})).open(request, timeout=timeout) as got:
            reply = json.load(got)
        return Reply([(c.get("message") or {}).get("content") for c in reply.get("choices", [])], usage_of(reply, samples))

    return answer


def asked(answer: Answer, endpoint: Endpoint, turns: list[dict], samples: int, attempts: int, pause: float) -> Reply:
    """One request with its attempts: exactly `samples` texts, null where a choice is missing; Unanswered after the last."""
    last = ""
    for k in range(attempts):
        try:
            got = answer(endpoint, turns, samples)
        except OSError as no:
            last = f"{type(no).__name__}: {no}"
            time.sleep(pause * (k + 1))
            continue
        reply = got if isinstance(got, Reply) else Reply(list(got))
        return Reply((reply.texts + [None] * samples)[:samples], reply.usage and {**reply.usage, "n": samples})
    raise Unanswered(f"{endpoint.label} gave no answer in {attempts} attempts; the last failed with {last}")


def generate(prompts: DataFrame, answer: Answer, endpoint: Endpoint, samples: int, key: str = "item_id", messages: str = "messages", attempts: int = 3, pause: float = 2.0, under_way: int = 16) -> DataFrame:
    """The key and ANSWERS: `samples` sample rows for each prompt, and a usage row where the server counts.

    A request without an answer fails its task, and so the job: missing answers must not
    pass for answers that couldn't be parsed.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(under_way) as workers:
            for frame in frames:
                turns = [[dict(m) if isinstance(m, dict) else m.asDict() for m in row] for row in frame[messages]]
                got = workers.map(lambda t: asked(answer, endpoint, t, samples, attempts, pause), turns)
                rows = []
                for k, reply in zip(frame[key], got, strict=True):
                    rows += [(k, "sample", i, raw, None, None, None, None) for i, raw in enumerate(reply.texts)]
                    if reply.usage:
                        rows.append((k, "usage", None, None, *(reply.usage.get(c) for c in _COLUMNS[3:])))
                out = pd.DataFrame(rows, columns=[key, *_COLUMNS])
                yield out.astype({c: "Int64" for c in ("sample", "prompt_tokens", "completion_tokens", "n")})

    return prompts.select(key, messages).mapInPandas(run, f"{key} {prompts.schema[key].dataType.simpleString()}, {ANSWERS}")


def sample_rows(answers: DataFrame, *keys: str) -> DataFrame:
    return answers.where("kind = 'sample'").select(*keys, "sample", "raw")


def usage_rows(answers: DataFrame, *keys: str) -> DataFrame:
    """A row for each request: tokens, choices asked for and why they ended."""
    return answers.where("kind = 'usage'").select(*keys, "prompt_tokens", "completion_tokens", "n", "finish_reasons")


def finished_rows(usage: DataFrame, *keys: str) -> DataFrame:
    """Usage with the number of truncated and of all choices."""
    cut = F.size(F.filter("finish_reasons", lambda r: r == "length"))
    return usage.select(*keys, "completion_tokens", "n", cut.alias("truncated"), F.size("finish_reasons").alias("choices"))
