"""Settings: defaults, then a file, then the environment, then flags; unknown names are refused."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields

from spanlight.errors import SettingsError
from spanlight.functions.text import Confirmation
from spanlight.model import Budget
from spanlight.operators.select import ORDERINGS

ENV_PREFIX = "SPANLIGHT_"


@dataclass(frozen=True)
class Settings:
    store: str = ".spanlight/store"
    index: str = ".spanlight/index"
    indexes: str = ""  # name=path pairs, comma-separated
    budget: str = "characters:4000"
    candidate_limit: int = 50
    limit: int = 10
    context: int = 400
    ordering: str = "score"
    minimum_score: float = 0.0
    redundancy: float = 0.75
    coverage_threshold: float = 1.0
    relative_match_floor: float = 0.8
    inflection_tail: int = 2

    def __post_init__(self) -> None:
        Budget.parse(self.budget)
        if self.ordering not in ORDERINGS:
            raise SettingsError(f"unknown ordering {self.ordering!r}")
        for name in ("candidate_limit", "limit", "context"):
            if getattr(self, name) <= 0:
                raise SettingsError(f"{name} is above 0")
        self.confirmation()

    def confirmation(self) -> Confirmation:
        return Confirmation(self.coverage_threshold, self.relative_match_floor, self.inflection_tail)

    def named_indexes(self) -> dict[str, str]:
        """Paths of indexes by name; queries name indexes, never paths."""
        out = dict(pair.split("=", 1) for pair in self.indexes.split(",") if pair)
        if any("/" in name for name in out):
            raise SettingsError("an index has a name, not a path")
        return out | {"default": self.index}


def _typed(name: str, value: object) -> object:
    kind = next((f.type for f in fields(Settings) if f.name == name), None)
    if kind is None:
        raise SettingsError(f"unknown setting {name!r}")
    try:
        return {"int": int, "float": float, "str": str}[str(kind)](value)
    except ValueError as e:
        raise SettingsError(f"{name} is not {kind}: {value!r}") from e


def load(path: str | None = None, env: Mapping[str, str] | None = None, flags: Mapping[str, object] | None = None) -> Settings:
    env = os.environ if env is None else env
    values = asdict(Settings())
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            values |= {k: _typed(k, v) for k, v in json.load(f).items()}
    values |= {k[len(ENV_PREFIX) :].lower(): _typed(k[len(ENV_PREFIX) :].lower(), v) for k, v in env.items() if k.startswith(ENV_PREFIX)}
    values |= {k: _typed(k, v) for k, v in (flags or {}).items() if v is not None}
    return Settings(**values)
