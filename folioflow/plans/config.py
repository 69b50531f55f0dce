"""Settings of a digest, checked when they are made."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from folioflow.functions.globs import checked_patterns
from folioflow.operators.pinning import resolve_cap, resolve_keywords
from folioflow.operators.ranking import resolve_topk


@dataclass(frozen=True)
class DigestConfig:
    """What a digest is made of; wrong kinds of values are corrected or refused as each setting says."""

    sources: tuple[str, ...] = ()
    categories: dict = field(default_factory=dict)
    cross_listed: bool = False
    include_path: list | None = None
    ignore_path: list | None = None
    topk: object = 10
    pin_keywords: list | None = None
    max_pinned: object = 20
    max_papers: int | None = 100
    overflow: str = "compat"
    send_empty: bool = False
    debug: bool = False
    debug_rows: int = 10
    language: str = "English"
    summary_tokens: int = 4000
    affiliation_tokens: int = 2000
    enrich_tasks: int = 8
    extract_seconds: float = 180.0

    def __post_init__(self) -> None:
        checked_patterns(self.include_path, "include_path")
        checked_patterns(self.ignore_path, "ignore_path")
        if self.overflow not in ("compat", "by_score"):
            raise ValueError("overflow is compat or by_score")

    @property
    def k(self) -> int:
        return resolve_topk(self.topk)

    @property
    def keywords(self) -> list[str]:
        return resolve_keywords(self.pin_keywords)

    @property
    def cap(self) -> int:
        return resolve_cap(self.max_pinned)

    @staticmethod
    def load(base: dict, custom: dict | None = None) -> "DigestConfig":
        """base under custom, key by key at every depth; ${NAME} in a text is that variable of the environment, ${NAME:default} one that may be missing."""
        told = resolved(merged(base, custom or {}))
        return replace(DigestConfig(), **told)

    @staticmethod
    def read(base: str, custom: str | None = None) -> "DigestConfig":
        """The settings of a file (JSON, TOML or, with its package installed, YAML) under those of another, which may be missing."""
        return DigestConfig.load(read_settings(base), read_settings(custom) if custom and Path(custom).exists() else None)


def merged(base: dict, custom: dict) -> dict:
    """base with custom's values in place of its own; two dictionaries under one key are merged alike."""
    out = dict(base)
    for k, v in custom.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


_VARIABLE = re.compile(r"\$\{(\w+)(?::([^}]*))?\}")


def resolved(value: object) -> object:
    """value with the variables in its texts filled in, at every depth; a text that is one missing variable is None."""
    if isinstance(value, dict):
        return {k: resolved(v) for k, v in value.items()}
    if isinstance(value, list):
        return [resolved(v) for v in value]
    if not isinstance(value, str):
        return value
    whole = _VARIABLE.fullmatch(value)
    if whole:
        return os.environ.get(whole[1], whole[2])
    return _VARIABLE.sub(lambda m: os.environ.get(m[1], m[2] or ""), value)


def read_settings(path: str) -> dict:
    """A settings file as a dictionary, by its ending."""
    text, kind = Path(path).read_text(encoding="utf-8"), Path(path).suffix.lower()
    if kind == ".json":
        return json.loads(text)
    if kind == ".toml":
        return tomllib.loads(text)
    if kind in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML settings need the package yaml") from e
        return yaml.safe_load(text) or {}
    raise ValueError(f"settings are JSON, TOML or YAML, not {kind}")
