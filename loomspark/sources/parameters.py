"""Nested parameters: an object over another, member by member."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge(base: dict[str, Any], override: dict[str, Any]) -> dict[str, Any]:
    """``base`` with the members of ``override``; where both have an object these are merged, anything else is replaced."""
    out = dict(base)
    for name, value in override.items():
        out[name] = merge(out[name], value) if isinstance(out.get(name), dict) and isinstance(value, dict) else value
    return out


def load(text: str, base: dict[str, Any] | None = None) -> dict[str, Any]:
    """Parameters from JSON text, or from the file behind an ``@``, over ``base``."""
    if text.startswith("@"):
        with open(text[1:], encoding="utf-8") as file:
            text = file.read()
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("parameters are an object")
    return merge(base or {}, found)


def overridden(defaults: dict[str, Any], props: str) -> Column:
    """The members of a row's flat JSON object over ``defaults``, as a map of strings; null or broken text changes nothing."""
    base = ", ".join(f"'{k}', '{json.dumps(v) if not isinstance(v, str) else v}'" for k, v in defaults.items())
    own = f"coalesce(from_json({props}, 'map<string,string>'), CAST(map() AS map<string,string>))"
    return F.expr(f"map_concat(map_filter(map({base}), (k, v) -> NOT map_contains_key({own}, k)), {own})")
