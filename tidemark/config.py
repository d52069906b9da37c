"""Settings, from the environment where it has them (``TIDEMARK_`` and the field's name in capitals)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from datetime import timedelta


@dataclass(frozen=True)
class Settings:
    root: str = "data/ledger"
    checkpoint: str = "data/checkpoint"
    bootstrap_servers: str = "localhost:9092"
    topic: str = "payments"
    window_seconds: int = 60
    allowed_lateness_seconds: int = 120
    trigger_seconds: int = 5
    max_offsets_per_trigger: int = 2000
    starting_offsets: str = "earliest"

    @property
    def window(self) -> timedelta:
        return timedelta(seconds=self.window_seconds)

    @property
    def allowed_lateness(self) -> timedelta:
        return timedelta(seconds=self.allowed_lateness_seconds)

    @classmethod
    def from_env(cls) -> Settings:
        """An unset or empty variable leaves the default."""
        found = {}
        for field in fields(cls):
            text = os.environ.get(f"TIDEMARK_{field.name.upper()}", "")
            if text:
                found[field.name] = type(field.default)(text)
        return cls(**found)
