"""Piecewise-linear tables: arrays of struct<u, v> in order of u, as SQL expressions."""

from __future__ import annotations


def interpolate(table: str, u: str) -> str:
    """Between the entries before and behind u; the first or last value beyond the ends."""
    below = f"array_max(filter({table}, e -> e.u <= {u}))"
    above = f"array_min(filter({table}, e -> e.u >= {u}))"
    between = f"{below}.v + ({above}.v - {below}.v) * ({u} - {below}.u) / nullif({above}.u - {below}.u, 0)"
    return f"CASE WHEN {below} IS NULL THEN {above}.v WHEN {above} IS NULL OR {above}.u = {below}.u THEN {below}.v ELSE {between} END"
