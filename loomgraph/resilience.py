"""Repeated attempts with growing pauses, and a health probe that isn't asked too often."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass


def retry(f: Callable, attempts: int = 4, pause: float = 1.0, longest: float = 30.0, factor: float = 2.0, errors: tuple = (Exception,), sleep: Callable[[float], None] = time.sleep):
    """``f()``; after one of ``errors`` again, ``attempts`` times in all, with pauses that grow up to ``longest``."""
    for k in range(attempts):
        try:
            return f()
        except errors:
            if k == attempts - 1:
                raise
            sleep(min(pause * factor**k, longest))


@dataclass
class Health:
    """Whether a service answers, asked at most every ``every`` seconds."""

    probe: Callable[[], bool]
    every: float = 30.0
    clock: Callable[[], float] = time.monotonic
    asked: float | None = None
    well: bool = False

    def ok(self) -> bool:
        now = self.clock()
        if self.asked is None or now - self.asked >= self.every:
            try:
                self.well = bool(self.probe())
            except Exception:  # noqa: BLE001  a failing probe is an unhealthy service
                self.well = False
            self.asked = now
        return self.well
