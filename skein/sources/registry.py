"""Descriptors of sources, and configuration from environment, file and defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

#: Older names of capabilities.
ALIASES = {"search": "federated_search", "changes": "change_feed", "read": "read_unit"}


@dataclass(frozen=True)
class Descriptor:
    name: str
    capabilities: tuple[str, ...]
    cursor: str | None = None
    auth: str | None = None
    settings: tuple[str, ...] = ()

    @property
    def normalized(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(ALIASES.get(c, c) for c in self.capabilities))


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, Descriptor] = {}

    def register(self, d: Descriptor) -> None:
        if d.name in self._known:
            raise ValueError(f"{d.name} is registered")
        self._known[d.name] = d

    def get(self, name: str) -> Descriptor:
        if name not in self._known:
            raise KeyError(f"unknown source {name}; known: {', '.join(sorted(self._known))}")
        return self._known[name]

    def all(self) -> list[Descriptor]:
        return [self._known[n] for n in sorted(self._known)]


def default_registry() -> Registry:
    r = Registry()
    r.register(Descriptor("filesystem", ("discover", "read")))
    r.register(Descriptor("telegram", ("changes", "read", "search"), cursor="offset", settings=("socket_path",)))
    r.register(Descriptor("gmail", ("search",), auth="oauth2", settings=("token",)))
    return r


@dataclass
class Settings:
    """Engine settings: environment (SKEIN_*) before a TOML file before defaults."""

    chunk_tokens: int = 512
    chunk_overlap: int = 50
    score_floor: float = 0.85
    rerank_pool: int = 20
    fused_weight: float = 0.4
    rerank_weight: float = 0.6
    embedding_weights: str = "text=0.7,meta=0.3"
    exclude: list[str] = field(default_factory=lambda: [".git", "node_modules"])
    extra_exclude: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | None = None) -> Settings:
        import tomllib

        held = tomllib.loads(Path(path).read_text()) if path and Path(path).exists() else {}
        out = cls()
        for f in fields(cls):
            value = os.environ.get(f"SKEIN_{f.name.upper()}", held.get(f.name))
            if value is not None:
                now = getattr(out, f.name)
                setattr(out, f.name, value if isinstance(value, list) else value.split(",") if isinstance(now, list) else type(now)(value))
        return out

    @property
    def excluded(self) -> list[str]:
        return list(dict.fromkeys([*self.exclude, *self.extra_exclude]))
