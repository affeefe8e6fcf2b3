"""What runs need besides data: folders, logs, and a training loop for small models."""

from __future__ import annotations

import contextlib
import logging
import math
import os
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np

#: Environment variables that name the data and the report folder.
DATA_VARIABLE, REPORT_VARIABLE = "TESSERA_DATA", "TESSERA_REPORTS"


def data_root(explicit: str | None = None, default: str = "data") -> Path:
    """The data folder: the explicit one, else the environment's, else the default; it must exist."""
    found = Path(explicit or os.environ.get(DATA_VARIABLE) or default).expanduser()
    if not found.is_dir():
        raise FileNotFoundError(f"no data folder {found}: name one, or set {DATA_VARIABLE}")
    return found.resolve()


def report_root(explicit: str | None = None, default: str = "reports") -> Path:
    """The report folder by the same precedence; it is made where it is missing."""
    found = Path(explicit or os.environ.get(REPORT_VARIABLE) or default).expanduser()
    found.mkdir(parents=True, exist_ok=True)
    return found.resolve()


class _Plain(logging.Formatter):
    """Messages as they are; those above INFO with their level in front."""

    def format(self, record: logging.LogRecord) -> str:
        text = record.getMessage()
        return text if record.levelno == logging.INFO else f"{record.levelname}: {text}"


def logger(name: str = "tessera") -> logging.Logger:
    """The package's logger, which writes to standard error once."""
    held = logging.getLogger(name)
    if not held.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(_Plain())
        held.addHandler(handler)
        held.setLevel(logging.INFO)
        held.propagate = False
    return held


@contextlib.contextmanager
def run_log(path: str | Path, name: str = "tessera") -> Iterator[logging.Logger]:
    """While it lasts, the logger's messages also go to a file."""
    held = logger(name)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(_Plain())
    held.addHandler(handler)
    try:
        yield held
    finally:
        held.removeHandler(handler)
        handler.close()


@dataclass(frozen=True)
class Schedule:
    """Epochs over a number of batches: as many as a budget of steps needs, or as many as asked for."""

    batches: int
    steps: int | None = None
    epochs: int = 100

    def __post_init__(self):
        if self.batches < 1:
            raise ValueError("there is nothing to train on")

    @property
    def whole_epochs(self) -> int:
        return max(1, math.ceil(self.steps / self.batches)) if self.steps else self.epochs

    @property
    def total(self) -> int:
        return self.whole_epochs * self.batches

    def rate(self, step: int, rate: float) -> float:
        """Cosine annealing from ``rate`` to 0 over all steps."""
        return rate * (1 + math.cos(math.pi * min(step, self.total) / self.total)) / 2


def train(weights: list[np.ndarray], batches: Callable[[], Iterable], slopes: Callable, schedule: Schedule, rate: float, decay: float = 0.0, clip: float | None = None) -> list[dict[str, float]]:
    """Adam with cosine annealing, in place on ``weights``: the mean of each part of the loss, by epoch.

    ``slopes(weights, batch)`` gives the parts of the loss (the minimised one is ``loss``)
    and the gradients; it can add up partial gradients of a Spark aggregation.
    """
    first, second, step, history = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0, []
    for _ in range(schedule.whole_epochs):
        totals: dict[str, float] = {}
        seen = 0
        for batch in batches():
            parts, gradients = slopes(weights, batch)
            gradients = [g + decay * w for g, w in zip(gradients, weights, strict=True)]
            size = math.sqrt(sum(float((g * g).sum()) for g in gradients))
            if clip is not None and size > clip:
                gradients = [g * (clip / size) for g in gradients]
            now = schedule.rate(step, rate)
            step += 1
            for w, g, m, v in zip(weights, gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            for name, value in parts.items():
                totals[name] = totals.get(name, 0.0) + float(value)
            seen += 1
        history.append({name: value / max(seen, 1) for name, value in totals.items()})
    return history
