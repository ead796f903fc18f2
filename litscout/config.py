"""Settings from YAML files, with environment variables put in."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


USER_AGENT = "litscout/1"


def secret(variable: str, given: str = "") -> str:
    """A configured value, else the environment's; empty without both. It is read on the driver, so executors need no secrets in their environment."""
    return given or os.environ.get(variable, "") if variable else given


@dataclass
class LibraryApi:
    base_url: str = ""
    user_id: str = ""
    api_key_env: str = "LIBRARY_API_KEY"
    headers: dict[str, str] = field(default_factory=dict)
    page_size: int = 100
    polite_delay_ms: int = 200

    def address(self) -> str:
        return self.base_url.rstrip("/") + (f"/users/{self.user_id}" if self.user_id else "")

    def all_headers(self) -> dict[str, str]:
        """What every request carries beside the key, such as the interface's version."""
        return {"User-Agent": USER_AGENT} | self.headers


@dataclass
class Library:
    MODES = ("api", "bbt")
    mode: str = "api"
    api: LibraryApi = field(default_factory=LibraryApi)

    def __post_init__(self) -> None:
        one_of(self.MODES, "mode", self.mode)


def one_of(allowed: tuple[str, ...], name: str, value: str) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass
class UnifiedApi:
    enabled: bool = True
    base_url: str = ""
    api_key_value: str = ""
    api_key_env: str = "UNIFIED_API_KEY"
    api_key_header: str = "X-API-Key"
    page_size: int = 200
    timeout_s: int = 30


@dataclass
class Toggle:
    enabled: bool = True
    base_url: str = ""
    mailto: str = ""
    categories: list[str] = field(default_factory=list)


@dataclass
class Sources:
    window_days: int = 30
    queries: list[str] = field(default_factory=list)
    tracked_venues: list[str] = field(default_factory=list)
    include_keywords: list[str] = field(default_factory=list)
    exclude_keywords: list[str] = field(default_factory=list)
    required_keyword_groups: list[list[str]] = field(default_factory=list)
    required_any_group_sets: list[list[list[str]]] = field(default_factory=list)
    require_topic_match: bool = False
    unified: UnifiedApi = field(default_factory=UnifiedApi)
    graph: Toggle = field(default_factory=Toggle)
    registry: Toggle = field(default_factory=Toggle)
    feed: Toggle = field(default_factory=Toggle)
    bio: Toggle = field(default_factory=Toggle)
    med: Toggle = field(default_factory=Toggle)

    def topic_queries(self, default: str = "literature") -> list[str]:
        """SRC13: non-blank queries, else the default."""
        return [q.strip() for q in self.queries if q.strip()] or [default]

    def enabled(self) -> list[str]:
        """SRC12: names of the sources that are on, in their fixed order."""
        return [n for n in ("graph", "registry", "feed", "bio", "med") if getattr(self, n).enabled]


@dataclass
class Weights:
    similarity: float = 0.45
    recency: float = 0.15
    citations: float = 0.15
    altmetric: float = 0.10
    journal_quality: float = 0.08
    author_bonus: float = 0.02
    venue_bonus: float = 0.05

    def as_dict(self) -> dict[str, float]:
        return {f.name: float(getattr(self, f.name)) for f in fields(self)}


@dataclass
class Thresholds:
    must_read: float = 0.75
    consider: float = 0.5


@dataclass
class Scoring:
    weights: Weights = field(default_factory=Weights)
    thresholds: Thresholds = field(default_factory=Thresholds)
    decay_days: dict[str, int] = field(default_factory=lambda: {"fast": 30, "medium": 60, "slow": 180})
    whitelist_authors: list[str] = field(default_factory=list)
    whitelist_venues: list[str] = field(default_factory=list)


@dataclass
class Settings:
    library: Library = field(default_factory=Library)
    sources: Sources = field(default_factory=Sources)
    scoring: Scoring = field(default_factory=Scoring)


def expand(value: Any) -> Any:
    """Environment variables in all strings; those not set stay as they are written."""
    if isinstance(value, str):
        return os.path.expandvars(value)
    if isinstance(value, list):
        return [expand(v) for v in value]
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    return value


def build(kind: type, value: dict | None) -> Any:
    """A settings object from a mapping; unknown keys are left out, nested ones are built likewise."""
    value = value or {}
    given = {}
    for f in fields(kind):
        if f.name in value:
            default = f.default_factory() if callable(f.default_factory) else None
            given[f.name] = build(type(default), value[f.name]) if is_dataclass(default) else value[f.name]
    return kind(**given)


def load_yaml(path: Path) -> dict:
    import yaml

    if not path.exists():
        raise FileNotFoundError(path)
    found = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return expand(found)


def load_settings(folder: str | Path) -> Settings:
    """SRC23: library.yaml, sources.yaml and scoring.yaml of a folder."""
    folder = Path(folder)
    return Settings(
        build(Library, load_yaml(folder / "library.yaml")),
        build(Sources, load_yaml(folder / "sources.yaml")),
        build(Scoring, load_yaml(folder / "scoring.yaml")),
    )
