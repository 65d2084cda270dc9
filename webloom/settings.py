"""Parameters of scraping and crawling jobs, with the defaults; every function takes what it needs from here."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    page_timeout_ms: int = 30_000
    max_attempts: int = 5
    max_retries: int = 3
    backoff_max_s: float = 30.0
    jitter: float = 0.2
    per_domain_rps: float = 1.0
    cooldown_s: float = 60.0
    session_max_error: float = 3.0
    session_max_usage: int = 50
    max_pages: int = 500
    max_depth: int = 3
    workers: int = 2

    @classmethod
    def from_environment(cls, prefix: str = "WEBLOOM_") -> Settings:
        """Values of the environment, in the type of their default."""
        given = {f.name: type(f.default)(os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return cls(**given)
