"""Configuration of projects and their repositories, from a JSON or YAML-like mapping."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class Repo:
    """A source tree and the languages to read in it (all of the known ones, if none is named)."""

    root: str
    languages: list[str] = field(default_factory=list)


@dataclass
class Project:
    """Repositories of one project, the store they share, and the least strength of its links."""

    repos: dict[str, Repo] = field(default_factory=dict)
    base_store: str | None = None
    link_threshold: float = 0.05


@dataclass
class Config:
    """Projects by name."""

    projects: dict[str, Project] = field(default_factory=dict)

    @classmethod
    def of(cls, data: dict | None) -> Config:
        """From a mapping; what is missing takes its default, unknown keys are an error."""
        known = {"repos", "base_store", "link_threshold"}
        out = cls()
        for name, p in ((data or {}).get("projects") or {}).items():
            p = p or {}
            if set(p) - known:
                raise ValueError(f"unknown settings of {name}: {sorted(set(p) - known)}")
            repos = {k: Repo(v["root"], list(v.get("languages") or [])) for k, v in (p.get("repos") or {}).items()}
            out.projects[name] = Project(repos, p.get("base_store"), float(p.get("link_threshold", Project.link_threshold)))
        return out

    @classmethod
    def load(cls, path: str) -> Config:
        """From a JSON file, or a YAML one where a YAML reader is installed; no file is an empty configuration."""
        file = Path(path)
        if not file.is_file():
            return cls()
        text = file.read_text("utf-8")
        if file.suffix in (".yaml", ".yml"):
            import yaml

            return cls.of(yaml.safe_load(text))
        return cls.of(json.loads(text))
