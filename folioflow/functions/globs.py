"""Glob patterns over paths."""

from __future__ import annotations

import glob

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked_patterns(patterns: object, setting: str) -> list[str] | None:
    """A list of patterns, or None; a single text or anything but texts in it is a mistake."""
    if patterns is None:
        return None
    if isinstance(patterns, str) or not isinstance(patterns, (list, tuple)):
        raise TypeError(f"{setting} takes a list of glob patterns, not {type(patterns).__name__}")
    for p in patterns:
        if not isinstance(p, str):
            raise TypeError(f"{setting} takes glob patterns, not {type(p).__name__}")
    return list(patterns)


def glob_regex(pattern: str) -> str:
    """A Java regular expression for the whole path; ** crosses folders, wildcards skip a leading dot."""
    regex = glob.translate(pattern, recursive=True, include_hidden=False, seps="/")
    return "^" + regex.removesuffix(r"\Z").removesuffix(r"\z") + r"\z"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def any_path_matches(paths: Column, patterns: list[str]) -> Column:
    """Whether any path matches any pattern; false for null and no paths."""
    one = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    return F.coalesce(F.exists(paths, lambda p: p.rlike(one)), F.lit(False))
