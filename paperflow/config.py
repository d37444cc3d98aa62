"""The run's settings, checked as a whole before anything is read."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, fields
from typing import Any


class ConfigError(ValueError):
    """All the rules that a configuration breaks."""


@dataclass(frozen=True)
class Category:
    key: str
    weekday: int  # 1 is Monday
    label: str = ""
    fields: tuple[str, ...] = ()
    areas: tuple[str, ...] = ()


@dataclass(frozen=True)
class Limit:
    """A readability rule's limits; `inverted` where less is worse."""

    warn: float
    hard: float
    inverted: bool = False


@dataclass(frozen=True)
class Config:
    categories: tuple[Category, ...]
    weights: dict[str, float] = field(default_factory=lambda: {"explainability": 0.4, "everyday_relevance": 0.28, "freshness": 0.18, "credibility": 0.14})
    papers_per_day: int = 5
    least_papers: int = 3
    cap: int = 2
    gate: float = 0.35
    shortlist: int = 20
    freshness_days: int = 7
    window_days: int = 180
    least_abstract_chars: int = 400
    max_calls: int = 60
    regenerations: int = 2
    language: str = "cs"
    relaxed_cap: int = 3
    retries: int = 2
    backoff_ms: tuple[int, ...] = (1000, 3000)
    limits: dict[str, Limit] = field(default_factory=dict)

    def __post_init__(self) -> None:
        falling, limits = list(self.weights.values()), self.limits.values()
        rules = {
            "weights must sum to 1": abs(sum(falling) - 1) <= 1e-6,
            "weights must fall in their order": all(a > b for a, b in zip(falling, falling[1:], strict=False)),
            "the relaxed cap must reach the cap": self.relaxed_cap >= self.cap,
            "the least number of papers must not pass the day's": self.least_papers <= self.papers_per_day,
            "each weekday must have one category": sorted(c.weekday for c in self.categories) == list(range(1, 8)),
            "category keys must differ": len({c.key for c in self.categories}) == len(self.categories),
            "a hard limit must be worse than its warning": all((x.hard < x.warn) if x.inverted else (x.hard > x.warn) for x in limits),
            "there must be a backoff for each retry": len(self.backoff_ms) >= self.retries,
        }
        if broken := [rule for rule, holds in rules.items() if not holds]:
            raise ConfigError("; ".join(broken))

    def category(self, weekday: int) -> Category:
        for c in self.categories:
            if c.weekday == weekday:
                return c
        raise ConfigError(f"no category for weekday {weekday}")

    @classmethod
    def read(cls, text: str) -> Config:
        """Settings from JSON; unknown names and wrong types are errors, as are broken rules."""
        raw = json.loads(text)
        known = {f.name for f in fields(cls)}
        if strange := sorted(set(raw) - known):
            raise ConfigError(f"unknown settings: {', '.join(strange)}")
        try:
            raw["categories"] = tuple(Category(**{k: tuple(v) if isinstance(v, list) else v for k, v in c.items()}) for c in raw.get("categories", []))
            raw["limits"] = {k: Limit(**v) for k, v in raw.get("limits", {}).items()}
        except TypeError as error:
            raise ConfigError(str(error)) from error
        if "backoff_ms" in raw:
            raw["backoff_ms"] = tuple(raw["backoff_ms"])
        return cls(**raw)

    def selection(self) -> dict[str, Any]:
        """What the selection of a day takes from the settings."""
        return {"cap": self.cap, "limit": self.papers_per_day, "least": self.least_papers}


def resolved(names: Iterable[str], known: Mapping[str, str]) -> list[str]:
    """Ids of names, compared without case and surplus blanks. All must be known, or none is returned."""
    plain = lambda name: " ".join(name.split()).lower()
    ids = {plain(k): v for k, v in known.items()}
    if missing := [n for n in names if plain(n) not in ids]:
        raise ConfigError(f"unknown fields: {', '.join(missing)}")
    return [ids[plain(n)] for n in names]


def secrets(names: Iterable[str], lines: str = "", environment: Mapping[str, str] | Callable[[], Mapping[str, str]] = os.environ) -> dict[str, str]:
    """Values of `NAME=value` lines (comments and quotes allowed); the environment goes before them, and blank is absent."""
    found: dict[str, str] = {}
    for line in lines.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
        if m:
            value = m[2]
            found[m[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value.split(" #")[0].strip()
    here = environment() if callable(environment) else environment
    return {n: v for n in names if (v := here.get(n) or found.get(n))}
