"""Clients of model servers, and their use from executors.

A client has ``ask(prompt) -> (text, tokens)`` and raises on failure; ``close`` is optional. It is made
on the executor by a factory, so connections are never shipped. ``Replay`` answers from a table,
for offline runs and tests.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ..schemas import RESPONSE

#: The server's request fields and options.
FIELDS = {"stream": False, "keep_alive": "10m", "think": False}
OPTIONS = {"temperature": 0.0, "top_p": 1.0, "seed": 20260803, "num_predict": 200}


@dataclass
class HttpClient:
    """Posts JSON to a completion endpoint; ``text`` and ``tokens`` are the paths of both in the reply."""

    url: str
    model: str
    options: dict[str, Any] = field(default_factory=lambda: dict(OPTIONS))
    text: tuple = ("response",)
    tokens: tuple = ("eval_count",)
    timeout: float = 300.0
    headers: dict[str, str] = field(default_factory=dict)

    def ask(self, prompt: str) -> tuple[str, int | None]:
        body = json.dumps({"model": self.model, "prompt": prompt, "options": self.options, **FIELDS}).encode()
        request = urllib.request.Request(self.url, data=body, headers={"Content-Type": "application/json", **self.headers})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            found = json.load(reply)
        return _at(found, self.text), _at(found, self.tokens, None)

    def close(self) -> None:
        """Asks the server to release the model."""
        body = json.dumps({"model": self.model, "keep_alive": 0}).encode()
        try:
            urllib.request.urlopen(urllib.request.Request(self.url, data=body), timeout=30).close()
        except OSError:
            pass


@dataclass
class GeneratorClient:
    """Posts to a generator of the ``generateContent`` kind, whose replies come in parts. Made without a key it raises: nothing else needs one."""

    url: str
    model: str
    temperature: float = 1.0
    max_tokens: int = 4096
    key: str = field(default="", repr=False)
    timeout: float = 180.0

    def __post_init__(self) -> None:
        if not self.key:
            raise ValueError("the generator needs a key; analysing what has been collected does not")

    def ask(self, prompt: str) -> tuple[str, int | None]:
        body = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"temperature": self.temperature, "maxOutputTokens": self.max_tokens}}
        request = urllib.request.Request(f"{self.url}/{self.model}:generateContent?key={self.key}", data=json.dumps(body).encode(), headers={"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            found = json.load(reply)
        return "".join(part.get("text", "") for part in _at(found, ("candidates", 0, "content", "parts"))), None

    def delay(self, attempt: int) -> float:
        """Seconds before the next attempt: 1, 2, 4, ..."""
        return float(1 << (attempt - 1))


_REQUIRED = object()


def _at(found: Any, path: tuple, default: Any = _REQUIRED) -> Any:
    for key in path:
        if isinstance(found, dict) and key not in found and default is not _REQUIRED:
            return default
        found = found[key]
    return found


@dataclass
class Replay:
    """Answers from a dictionary of prompts; others fail."""

    answers: dict[str, str]

    def ask(self, prompt: str) -> tuple[str, int | None]:
        text = self.answers[prompt]
        return text, len(text.split())


def ask_patiently(client: Any, prompt: str, retries: int = 3, pause: float = 1.5, wait: Callable[[float], None] = time.sleep) -> tuple[str | None, int | None, str | None]:
    """(text, tokens, None), or (None, None, error) once every attempt has failed: a failed call is never an empty answer."""
    error = "no attempt"
    delay = getattr(client, "delay", lambda attempt: pause * attempt)
    for attempt in range(1, retries + 1):
        try:
            return (*client.ask(prompt), None)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                wait(delay(attempt))
    return None, None, error


def collected(work: DataFrame, factory: Callable[[], Any], workers: int = 6, retries: int = 3, pause: float = 1.5) -> DataFrame:
    """Responses to a work list (p, i, prompt, turn, ord), asked by ``workers`` tasks at once in the list's order.

    Calls are repeated if a task is; keys (p, i) make that harmless.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        try:
            for frame in frames:
                rows = []
                for p, i, prompt in zip(frame["p"], frame["i"], frame["prompt"], strict=True):
                    began = time.monotonic()
                    text, tokens, error = ask_patiently(client, prompt, retries, pause)
                    rows.append((p, i, text, tokens, int((time.monotonic() - began) * 1000), error))
                out = pd.DataFrame(rows, columns=RESPONSE.names)
                yield out.astype({"p": "int64", "ms": "int64", "n": "Int64"})
        finally:
            getattr(client, "close", lambda: None)()

    dealt = work.repartitionByRange(workers, "turn").sortWithinPartitions("turn", "p", "ord")
    return dealt.select("p", "i", "prompt").mapInPandas(run, RESPONSE)
