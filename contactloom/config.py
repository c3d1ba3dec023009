"""Settings from the environment, a .env file, or a session's conf, checked on reading."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class CrawlerSettings:
    user_agent: str = "contactloom/1.0"
    respect_robots: bool = True
    timeout_seconds: float = 30.0
    max_retries: int = 3
    first_delay: float = 1.0
    backoff: float = 2.0
    min_delay_per_domain: float = 3.0
    max_delay_per_domain: float = 10.0

    def __post_init__(self):
        _within("timeout_seconds", self.timeout_seconds, 1, 600)
        _within("max_retries", self.max_retries, 0, 10)
        _within("min_delay_per_domain", self.min_delay_per_domain, 0, 3600)
        if self.max_delay_per_domain < self.min_delay_per_domain:
            raise ValueError("max_delay_per_domain is less than min_delay_per_domain")


@dataclass(frozen=True)
class StoreSettings:
    leads_path: str = "leads"
    batch_size: int = 500

    def __post_init__(self):
        _within("batch_size", self.batch_size, 1, 1_000_000)


@dataclass(frozen=True)
class LogSettings:
    level: str = "INFO"
    path: str = ""

    def __post_init__(self):
        if self.level not in ("TRACE", "DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"):
            raise ValueError(f"no such log level: {self.level}")


@dataclass(frozen=True)
class Settings:
    project: str = "contactloom"
    seeds_path: str = "seeds.csv"
    chambers_path: str = "chambers.csv"
    concurrency: int = 5
    profile: str = "strict"
    crawler: CrawlerSettings = field(default_factory=CrawlerSettings)
    store: StoreSettings = field(default_factory=StoreSettings)
    log: LogSettings = field(default_factory=LogSettings)

    def __post_init__(self):
        _within("concurrency", self.concurrency, 1, 1000)
        if self.profile not in ("strict", "extended"):
            raise ValueError(f"no such profile: {self.profile}")


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")


def dotenv(path: str | Path) -> dict[str, str]:
    """``NAME=value`` lines of a file; comments and blank lines left out; a missing file is empty."""
    found = {}
    if Path(path).is_file():
        for line in Path(path).read_text().splitlines():
            name, sign, value = line.partition("=")
            if sign and not line.lstrip().startswith("#"):
                found[name.strip().removeprefix("export ").strip()] = value.strip().strip("\"'")
    return found


def _as(value: str, default: object) -> object:
    if isinstance(default, bool):
        if value.lower() not in ("1", "0", "true", "false", "yes", "no", "on", "off"):
            raise ValueError(f"no truth value: {value}")
        return value.lower() in ("1", "true", "yes", "on")
    return type(default)(value) if isinstance(default, (int, float)) else value


def load(env: Mapping[str, str] | None = None, env_file: str | Path | None = None, conf: Mapping[str, str] | None = None) -> Settings:
    """Settings by ``NAME`` or ``GROUP__NAME`` or ``GROUP_NAME`` (any case); the environment before the file before ``contactloom.group.name`` of the conf."""
    given = {k.removeprefix("contactloom.").replace(".", "__").lower(): v for k, v in (conf or {}).items() if k.startswith("contactloom.")}
    given |= {k.lower(): v for k, v in (dotenv(env_file) if env_file else {}).items()}
    given |= {k.lower(): v for k, v in (os.environ if env is None else env).items()}
    out, changed = Settings(), {}
    for f in fields(Settings):
        value = getattr(out, f.name)
        if isinstance(value, (CrawlerSettings, StoreSettings, LogSettings)):
            parts = {}
            for g in fields(value):
                raw = given.get(f"{f.name}__{g.name}", given.get(f"{f.name}_{g.name}"))
                if raw is not None:
                    parts[g.name] = _as(raw, getattr(value, g.name))
            if parts:
                changed[f.name] = replace(value, **parts)
        elif f.name in given:
            changed[f.name] = _as(given[f.name], value)
    return replace(out, **changed)
