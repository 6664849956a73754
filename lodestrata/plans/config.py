"""Settings of a project: JSON files laid over defaults."""

from __future__ import annotations

import copy
import json
from pathlib import Path

from pyspark.sql import Column

from ..operators.graph import library_of

NAME = ".lodestrata.json"
DEFAULTS = {"rules": {"enabled": None, "disabled": []}, "thresholds": {"routine_lines": 200, "nesting": 4, "complexity": 20}, "naming": {"project": "app", "custom": []}}


def merged(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, dictionaries key by key."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(start: str, name: str = NAME) -> dict:
    """Defaults under the nearest settings file in a folder or one above it."""
    for folder in [Path(start), *Path(start).resolve().parents]:
        if (folder / name).is_file():
            return merged(DEFAULTS, json.loads((folder / name).read_text(encoding="utf-8")))
    return copy.deepcopy(DEFAULTS)


def placed(name: Column, settings: dict) -> Column:
    """The library that an entry belongs to by its name, under a project's naming settings."""
    naming = settings["naming"]
    return library_of(name, naming["project"], [tuple(pair) for pair in naming["custom"]])
