"""A pipeline of steps: functions from DataFrame to DataFrame, folded lazily, so that the optimizer sees the whole chain."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]
STAGES = (("extractor", 1), ("predictor", 2), ("classifier", 2), ("reporter", 3), ("exporter", 3))
OTHER = 99


class Pipeline:
    def __init__(self, steps: list[Step] | None = None):
        self.steps: list[tuple[int, Step]] = []
        for s in steps or []:
            self.add(s)

    def add(self, step: Step, stage: int | None = None) -> Pipeline:
        """stage: its place; without one by the step's name. Steps of the same place keep their order."""
        if not callable(step):
            raise TypeError("a step must be callable")
        name = getattr(step, "__name__", type(step).__name__).lower()
        self.steps.append((stage if stage is not None else next((n for w, n in STAGES if w in name), OTHER), step))
        return self

    def run(self, df: DataFrame) -> DataFrame:
        if not self.steps:
            warnings.warn("the pipeline has no steps", stacklevel=2)
        for _, step in sorted(self.steps, key=lambda x: x[0]):
            df = df.transform(step)
        return df
