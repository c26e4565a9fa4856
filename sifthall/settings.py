"""Limits of polite collection and of schedules, as values that are checked once where they are made."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Limits:
    """Seconds unless named otherwise. Delays have a floor, and the least of a pair is not above the most."""

    least_delay: float = 5.0
    most_delay: float = 10.0
    least_rest: float = 180.0
    most_rest: float = 300.0
    rest_every: int = 50
    retries: int = 2
    most_run: float = 4 * 3600
    cooldown: float = 30 * 60
    failures: int = 3
    incremental_hours: int = 6
    full_days: int = 7
    retry_minutes: int = 15

    def __post_init__(self) -> None:
        for f in fields(self):
            if not getattr(self, f.name) > 0 and f.name != "retries":
                raise ValueError(f"{f.name} must be positive")
        if self.retries < 0 or self.least_delay < 1:
            raise ValueError("retries must not be negative, and a delay is a second at least")
        if self.least_delay > self.most_delay or self.least_rest > self.most_rest:
            raise ValueError("the least of a pair must not be above the most")

    @classmethod
    def from_env(cls, prefix: str = "SIFTHALL_", env: Mapping[str, str] | None = None) -> Limits:
        """Limits from variables such as SIFTHALL_LEAST_DELAY; what is not set, or empty, keeps its default."""
        held = os.environ if env is None else env
        given = {f.name: held.get(prefix + f.name.upper(), "").strip() for f in fields(cls)}
        return cls(**{name: type(getattr(cls, name))(value) for name, value in given.items() if value})
