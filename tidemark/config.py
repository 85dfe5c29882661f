"""Settings of a tree: tidemark.toml, .tidemark.toml, or the table tool.tidemark of pyproject.toml."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields


@dataclass
class Settings:
    live: list[str] = field(default_factory=list)
    history: list[str] = field(default_factory=list)
    plans: list[str] = field(default_factory=list)
    lang: str = "en"


def load(folder: str) -> Settings:
    """The settings of `folder`; what is missing, cannot be read or has another type is left at its default."""
    for name in ("tidemark.toml", ".tidemark.toml", "pyproject.toml"):
        try:
            with open(os.path.join(folder, name), "rb") as f:
                data = tomllib.load(f)
        except (OSError, tomllib.TOMLDecodeError):
            continue
        if name == "pyproject.toml":
            data = data.get("tool", {}).get("tidemark", {})
        if data:
            plain = Settings()
            return Settings(**{f.name: data[f.name] for f in fields(Settings) if isinstance(data.get(f.name), type(getattr(plain, f.name)))})
    return Settings()
