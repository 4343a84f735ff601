"""Knobs of the rule pipeline, and a loader for YAML files with ${VAR} and ${VAR:default} values."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    # fixed values: the weights and limits that results depend on
    domain_weight: float = 0.5
    rake_weight: float = 0.3
    frequency_weight: float = 0.2
    min_concept_score: float = 0.15
    min_confidence: float = 0.4
    min_llm_confidence: float = 0.5
    similarity: float = 0.82
    temporal_successors: int = 3
    temporal_gap: int = 30
    cooccurrence_confidence: float = 0.45
    damping: float = 0.85
    chunk_chars: int = 25_000
    chunk_overlap: float = 0.2
    retry_chars: int = 15_000

    def __post_init__(self):
        if abs(self.domain_weight + self.rake_weight + self.frequency_weight - 1) > 1e-9:
            raise ValueError("the three score weights must add up to 1")


_VARIABLE = re.compile(r"\$\{([A-Za-z_]\w*)(?::([^}]*))?\}")


def substitute(value, env=None):
    """Replace ${VAR} and ${VAR:default} in every string of a tree; an unset variable without default becomes ''."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: env.get(m[1], m[2] or ""), value)
    return value


def resolve(path: str, root: str | None = None) -> str:
    """Relative paths count from root (default: the working directory); absolute ones and URIs stay."""
    return path if "://" in path or os.path.isabs(path) else str(Path(root or os.getcwd()) / path)


def load(path: str, env=None) -> Config:
    import yaml

    with open(resolve(path)) as f:
        tree = substitute(yaml.safe_load(f) or {}, env)
    flat = {}
    for section in tree.values():
        if isinstance(section, dict):
            flat |= {k: v for k, v in section.items() if not isinstance(v, dict)}
            flat |= {{"domain_match": "domain_weight", "rake": "rake_weight", "frequency": "frequency_weight"}.get(k, k): v for k, v in section.get("weights", {}).items()}
    known = {f.name: f.type for f in fields(Config)}
    return Config(**{k: (int if known[k] == "int" else float)(v) for k, v in flat.items() if k in known})


def validate(path: str, env=None) -> list[str]:
    """Problems of a configuration file; empty if it can be used."""
    try:
        load(path, env)
    except (OSError, ValueError, TypeError) as e:
        return [str(e)]
    return []


def api_key(service: str, tree: dict | None = None, env=None) -> str | None:
    """The environment's <SERVICE>_API_KEY, else the configuration's key, else None."""
    env = os.environ if env is None else env
    return env.get(f"{service.upper()}_API_KEY") or ((tree or {}).get(service) or {}).get("api_key") or None
