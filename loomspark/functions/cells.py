"""Edits of a layered weave's cells: arrays of yarns from the lowest level up, as SQL expressions."""

from __future__ import annotations


def push_down(cell: str, levels: int | str) -> str:
    """The lowest yarn goes on top, so many times; an empty cell stays."""
    k = f"(({levels}) % size({cell}))"
    return f"(CASE WHEN size({cell}) = 0 THEN {cell} ELSE concat(slice({cell}, {k} + 1, size({cell}) - {k}), slice({cell}, 1, {k})) END)"


def push_up(cell: str, levels: int | str) -> str:
    """The highest yarn goes below all, so many times."""
    return push_down(cell, f"size({cell}) - ({levels}) % size({cell})")


def add_layers(cell: str, kind: str, layers: int | str) -> str:
    return f"concat({cell}, array_repeat({kind}, {layers}))"


def delete_layers(cell: str, kind: str, layers: int | str) -> str:
    """Without the highest ``layers`` yarns of a kind."""
    above = f"size(filter(slice({cell}, i + 2, size({cell})), w -> w = {kind}))"
    return f"filter({cell}, (v, i) -> v != {kind} OR {above} >= {layers})"
