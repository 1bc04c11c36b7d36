"""Wall-clock timers."""

from __future__ import annotations

import time
from dataclasses import dataclass, field


@dataclass
class Timer:
    """Adds up the time between start and stop, or of ``with`` blocks."""

    total: float = 0.0
    runs: int = 0
    _began: float | None = field(default=None, repr=False)

    def start(self) -> Timer:
        self._began = time.perf_counter()
        return self

    def stop(self) -> float:
        took = time.perf_counter() - self._began
        self.total, self.runs, self._began = self.total + took, self.runs + 1, None
        return took

    __enter__ = start

    def __exit__(self, *_):
        self.stop()

    def elapsed(self) -> float:
        return self.total

    def report(self, name: str) -> str:
        return f"[{name}]: {self.total:.9f} s"

    def average(self, name: str) -> str:
        return f"[{name}]: {self.total / max(1, self.runs):.9f} s a run of {self.runs}"
