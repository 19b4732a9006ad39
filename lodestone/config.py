"""Layered configuration: defaults, the user's file, the project's file, the environment, then overrides; later layers win."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field
from pathlib import Path

LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
PREFIX = "LODESTONE_"


@dataclass
class Config:
    project_name: str = ""
    workspace_dir: str = ".lodestone"
    log_level: str = "INFO"
    plugin_dirs: list = field(default_factory=list)
    discovery: dict = field(default_factory=lambda: {"follow_symlinks": False, "include_directories": True, "ignore_patterns": [], "hash_algorithm": "sha256", "max_file_size": None})

    def __post_init__(self) -> None:
        self.log_level = str(self.log_level).upper()
        if self.log_level not in LOG_LEVELS:
            raise ValueError(f"log_level must be one of {', '.join(LOG_LEVELS)}")


def merged(base: dict, over: dict) -> dict:
    """``base`` with ``over`` laid upon it, mapping by mapping."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_yaml(path: Path) -> dict:
    if not path.exists():
        return {}
    import yaml

    data = yaml.safe_load(path.read_text("utf-8")) or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path}: the top level must be a mapping")
    return data


def coerced(raw: str):
    """true/1/yes and false/0/no are booleans, whole numbers are numbers."""
    low = raw.strip().lower()
    if low in ("true", "1", "yes"):
        return True
    if low in ("false", "0", "no"):
        return False
    return int(low) if low.lstrip("-").isdigit() else raw


def from_environment(environment: dict | None = None) -> dict:
    """``LODESTONE_DISCOVERY__MAX_FILE_SIZE=5`` as {"discovery": {"max_file_size": 5}}."""
    out: dict = {}
    for key, raw in (environment if environment is not None else os.environ).items():
        if key.startswith(PREFIX):
            *path, last = key[len(PREFIX) :].lower().split("__")
            at = out
            for p in path:
                at = at.setdefault(p, {})
            at[last] = coerced(raw)
    return out


def load(project: str | Path, overrides: dict | None = None, user_file: Path | None = None, environment: dict | None = None) -> Config:
    """Of the project's two possible files only the first that exists counts."""
    project = Path(project)
    data = merged(asdict(Config()), read_yaml(user_file or Path.home() / ".config" / "lodestone" / "config.yaml"))
    for path in (project / "lodestone.yaml", project / ".lodestone" / "config.yaml"):
        if path.exists():
            data = merged(data, read_yaml(path))
            break
    data = merged(merged(data, from_environment(environment)), overrides or {})
    known = asdict(Config())
    return Config(**{k: v for k, v in data.items() if k in known})
