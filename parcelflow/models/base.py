"""Models behind one interface. Backends run inside the workers, one a process. A backend answers single requests, several at once in threads, or whole batches if it has run_batch of its own."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from parcelflow.session import spread


@dataclass
class ModelOutput:
    text: str | None = None
    masks: list = field(default_factory=list)
    boxes: list = field(default_factory=list)
    raw: object = None


Request = tuple[list[str], str]
#: Threads of one task at most.
MOST_THREADS = 10
#: Characters of answers that a task holds before it hands them on.
HELD = 1 << 24


class Backend:
    """One model. run gives None where it fails; an exception counts as a failure of that request."""

    name = "backend"

    def run(self, images: list[str], prompt: str, **options) -> ModelOutput | None:
        raise NotImplementedError

    def run_batch(self, requests: list[Request], threads: int = 1) -> list[tuple[ModelOutput | None, str | None]]:
        """(output, error) of each request, in their order. Models that take a batch at once override this."""
        if min(threads, len(requests)) <= 1:
            return [self._safely(r) for r in requests]
        with ThreadPoolExecutor(min(threads, len(requests), MOST_THREADS)) as pool:
            return list(pool.map(self._safely, requests))

    def _safely(self, request: Request) -> tuple[ModelOutput | None, str | None]:
        try:
            return self.run(*request), None
        except Exception as e:  # noqa: BLE001 - a row's failure is its result
            return None, f"{type(e).__name__}: {e}"


class BatchBackend(Backend):
    """A model that answers a whole batch in one call: answer gets the requests and gives as many outputs, None where it fails. A failed call fails its batch."""

    name = "batch"

    def __init__(self, answer: Callable[[list[Request]], list[ModelOutput | None]]):
        self.answer = answer

    def run(self, images: list[str], prompt: str, **options) -> ModelOutput | None:
        return self.answer([(images, prompt)])[0]

    def run_batch(self, requests: list[Request], threads: int = 1) -> list[tuple[ModelOutput | None, str | None]]:
        try:
            got = self.answer(requests)
            if len(got) != len(requests):
                raise ValueError(f"{len(got)} answers to {len(requests)} requests")
            return [(r, None) for r in got]
        except Exception as e:  # noqa: BLE001 - a batch's failure is its rows' result
            return [(None, f"{type(e).__name__}: {e}")] * len(requests)


class Cooling(Backend):
    """Another backend's requests, each failure followed by a wait of base times the failures in a row, in all threads of the task together; a success ends it."""

    def __init__(self, backend: Backend, base: float, sleep: Callable[[float], None] = time.sleep):
        self.backend, self.name, self.base, self.sleep = backend, backend.name, base, sleep
        self.errors, self.until, self.lock = 0, 0.0, threading.Lock()

    def run(self, images: list[str], prompt: str, **options) -> ModelOutput | None:
        with self.lock:
            wait = self.until - time.monotonic()
        if wait > 0:
            self.sleep(wait)
        out = None
        try:
            out = self.backend.run(images, prompt, **options)
            return out
        finally:
            with self.lock:
                self.errors = 0 if out is not None else self.errors + 1
                self.until = time.monotonic() + self.base * self.errors if self.errors else 0.0


class StubBackend(Backend):
    """Deterministic answers without a model: for tests and dry runs."""

    name = "stub"

    def __init__(self, answer: Callable[[list[str], str], str | None] | None = None):
        self.answer = answer

    def run(self, images: list[str], prompt: str, **options) -> ModelOutput | None:
        if self.answer:
            text = self.answer(images, prompt)
            return None if text is None else ModelOutput(text)
        h = hashlib.sha256("|".join([prompt, *images]).encode()).hexdigest()
        return ModelOutput(f"Condition: {int(h[:2], 16) % 5}\nJustification: {h[2:10]}", boxes=[[0.0, 0.0, int(h[10:12], 16) + 1.0, int(h[12:14], 16) + 1.0]])


def resolve_text(value: str) -> str:
    """A file's contents if the value names one, else the value."""
    p = Path(value)
    try:
        return p.read_text().strip() if len(value) < 1024 and p.is_file() else value
    except OSError:
        return value


def with_retry(call: Callable[[], object], tries: int = 5, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> object:
    """call, again after 0.5, 1, 2 .. seconds if it raises; the last error goes through."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            sleep(base * 2**k)


def infer(df: DataFrame, backend: Callable[[], Backend], prompt: str, key: str = "id", images: str = "paths", batch: int = 4, most_images: int | None = None, cooldown: float = 0.0, threads: int = 1) -> DataFrame:
    """key, status (ok or failed), text, boxes, masks, error: the model's answer for each row. Each task makes one backend and hands it `batch` requests at a time, of which up to `threads` run at once; after failures it waits cooldown times their number in a row. Rows never raise. Rows are spread over the cluster; answers leave a task in batches as large as those that the rows came in, or of HELD characters."""
    text = resolve_text(prompt)

    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Cooling(backend(), cooldown) if cooldown else backend()
        frame = lambda out: pd.DataFrame(out, columns=[key, "status", "text", "boxes", "masks", "error"])
        for pdf in it:
            keys, paths = list(pdf[key]), list(pdf[images])
            out: list = []
            size = 0
            for at in range(0, len(keys), batch):
                got = model.run_batch([((list(p) if p is not None else [])[:most_images], text) for p in paths[at : at + batch]], threads)
                new = [(k, "ok" if r is not None else "failed", r.text if r else None, json.dumps(r.boxes) if r else None, json.dumps(r.masks) if r else None, e) for k, (r, e) in zip(keys[at : at + batch], got)]
                out += new
                size += sum(len(v) for row in new for v in row[2:] if v)
                if size > HELD:
                    yield frame(out)
                    out, size = [], 0
            if out:
                yield frame(out)

    return spread(df.select(key, images)).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, status string, text string, boxes string, masks string, error string")
