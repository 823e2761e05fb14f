"""Calls of a judging model that lose no dossier: bounded calls at once, a deadline, one retry, a list of models.

A task keeps at most `at_once` calls in flight and gives its rows in the order of its input. What went wrong is a
row with a status, never a missing one: a call past its deadline isn't tried again (a slow model is as
slow again), a passing fault is once, a context that is too small is enlarged once to what the model says it needs, and a
model that can't answer gives way to the next of the list."""

from __future__ import annotations

import math
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import salvage


class Passing(Exception):
    """A fault that may be gone when tried again: a broken connection, a server's error."""


class ContextTooSmall(Exception):
    def __init__(self, need: int):
        super().__init__(f"{need} tokens")
        self.need = need


class Unusable(Exception):
    """This model can't answer: it isn't there, or refuses the request's form."""


class SizedModel(Protocol):
    name: str

    def chat(self, request: str, context: int) -> str: ...


RESERVE, ROUND = 2048, 1024
"""Tokens kept for the reply, and what an enlarged context is rounded up to."""


@dataclass(frozen=True)
class Policy:
    deadline: float = 900.0
    at_once: int = 4
    context: int = 8192
    pause: float = 0.0
    retries: int = field(default=1)


@dataclass
class Outcome:
    status: str
    model: str | None
    attempts: int
    seconds: float
    reply: str | None
    error: str | None


def _timed(call: Callable[[], str], seconds: float) -> str:
    """The call's result; TimeoutError after `seconds`. The thread of a call that is given up ends with the worker."""
    box: dict[str, object] = {}

    def run() -> None:
        try:
            box["ok"] = call()
        except BaseException as e:  # noqa: BLE001
            box["error"] = e

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    if t.is_alive():
        raise TimeoutError(f"no reply within {seconds:g} s")
    if "error" in box:
        raise box["error"]  # type: ignore[misc]
    return str(box["ok"])


def ask(models: list[SizedModel], request: str, policy: Policy) -> Outcome:
    """One request's way through the models."""
    began, attempts, error = time.monotonic(), 0, None
    for model in models:
        context, enlarged, left = policy.context, False, policy.retries
        while True:
            attempts += 1
            try:
                reply = _timed(lambda m=model, c=context: m.chat(request, c), policy.deadline)
                return Outcome("ok", model.name, attempts, time.monotonic() - began, reply, None)
            except TimeoutError as e:
                return Outcome("timeout", model.name, attempts, time.monotonic() - began, None, str(e))
            except ContextTooSmall as e:
                error = f"{model.name}: {e}"
                if enlarged:
                    break
                context, enlarged = math.ceil((e.need + RESERVE) / ROUND) * ROUND, True
            except Passing as e:
                error = f"{model.name}: {e}"
                if not left:
                    break
                left -= 1
                time.sleep(policy.pause)
            except Exception as e:  # noqa: BLE001: whatever else a model raises, the next one is asked
                error = f"{model.name}: {e}"
                break
    return Outcome("failed", None, attempts, time.monotonic() - began, None, error or "no model")


def _in_order(items: list[tuple[int, str]], models: list[SizedModel], policy: Policy) -> Iterator[tuple[int, Outcome]]:
    """Outcomes in the order of the items, at most `at_once` in flight."""
    window: deque[tuple[int, threading.Thread, list[Outcome]]] = deque()

    def start(key: int, request: str) -> None:
        box: list[Outcome] = []
        t = threading.Thread(target=lambda: box.append(ask(models, request, policy)), daemon=True)
        t.start()
        window.append((key, t, box))

    for key, request in items:
        if len(window) >= max(1, policy.at_once):
            k, t, box = window.popleft()
            t.join()
            yield k, box[0]
        start(key, request)
    while window:
        k, t, box = window.popleft()
        t.join()
        yield k, box[0]


REPLIES = "doc_id long, status string, model string, attempts int, seconds double, reply string, error string"


def replies(requests: DataFrame, make: Callable[[], list[SizedModel]], policy: Policy | None = None) -> DataFrame:
    """A row a request (`doc_id`, `request`): `status` is ok, timeout or failed; requests without text fail."""
    how = policy or Policy()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = make()
        for b in batches:
            items = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            asked = [(k, r) for k, (_, r) in enumerate(items) if r]
            got = dict(_in_order(asked, models, how))
            every = [got.get(k, Outcome("failed", None, 0, 0.0, None, "no request")) for k in range(len(items))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in items], pa.int64()), pa.array([o.status for o in every], pa.string()), pa.array([o.model for o in every], pa.string()), pa.array([o.attempts for o in every], pa.int32()),
                    pa.array([o.seconds for o in every], pa.float64()), pa.array([o.reply for o in every], pa.string()), pa.array([o.error for o in every], pa.string()),
                ],
                names=["doc_id", "status", "model", "attempts", "seconds", "reply", "error"],
            )

    return requests.select("doc_id", "request").mapInArrow(f, REPLIES)


def judgements(answered: DataFrame) -> DataFrame:
    """`doc_id, ord, field_key, model_verdict` of the replies that came; a reply that breaks off keeps its whole objects."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, str(c.get("field_key")), c.get("verdict")) for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, c in enumerate(salvage(r or "")) if isinstance(c, dict)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["doc_id", "ord", "field_key", "model_verdict"])

    return answered.filter(F.col("status") == "ok").select("doc_id", "reply").mapInArrow(f, "doc_id long, ord int, field_key string, model_verdict string")


class Sized:
    """A plain model under a name, for the list."""

    def __init__(self, name: str, model):
        self.name, self.model = name, model

    def chat(self, request: str, context: int) -> str:
        return self.model.chat(request)
