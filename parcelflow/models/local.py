"""Models in the workers' own memory: one session a process, whole batches at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from parcelflow.models.base import BatchBackend, ModelOutput, Request

_sessions: dict[str, object] = {}


def session(path: str):
    """The ONNX session of a model file, loaded once a process."""
    if path not in _sessions:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # tasks are the parallelism
        _sessions[path] = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    return _sessions[path]


class OnnxBackend(BatchBackend):
    """A model file with one input. before turns the requests into the input array, whose first axis is the batch, and says which of them it could read (their positions); after turns the outputs of one of them into an answer."""

    def __init__(self, path: str, before: Callable[[list[Request]], tuple[list[int], np.ndarray]], after: Callable[[list[np.ndarray]], ModelOutput], name: str = "onnx"):
        self.path, self.before, self.after, self.name = path, before, after, name

    def answer(self, requests: list[Request]) -> list[ModelOutput | None]:
        at, x = self.before(requests)
        out: list[ModelOutput | None] = [None] * len(requests)
        if at:
            model = session(self.path)
            got = model.run(None, {model.get_inputs()[0].name: x})
            for k, i in enumerate(at):
                out[i] = self.after([g[k] for g in got])
        return out
