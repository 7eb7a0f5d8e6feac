"""Settings with defaults, from a JSON or, where a reader is installed, a YAML file."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Paths:
    source_dir: str = "."
    workspace: str = "workspace"
    chunks: str = ""


@dataclass(frozen=True)
class Runtime:
    timeline: str = "source"
    compat_comments: bool = False
    explosion: int = 5000
    max_depth: int = 16
    max_nodes: int = 75
    branches: int = 5


@dataclass(frozen=True)
class Settings:
    paths: Paths = field(default_factory=Paths)
    runtime: Runtime = field(default_factory=Runtime)


def settings_of(values: dict) -> Settings:
    """Known fields from nested values; what is missing keeps its default, what is unknown is an error."""
    parts = {}
    for f in dataclasses.fields(Settings):
        kind = {"paths": Paths, "runtime": Runtime}[f.name]
        parts[f.name] = kind(**(values.get(f.name) or {}))
    if unknown := set(values) - set(parts):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**parts)


def load_settings(path: str) -> Settings:
    """A missing file gives the defaults."""
    file = Path(path)
    if not file.exists():
        return Settings()
    if file.suffix == ".json":
        return settings_of(json.loads(file.read_text()))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs a YAML library; use JSON") from e
    return settings_of(yaml.safe_load(file.read_text()) or {})
