"""Polygons: arrays of struct<x, y>, closed from the last point to the first. SQL expressions over an array column."""

from __future__ import annotations


def _fold(ring: str, step: str, start: str = "0D", finish: str = "a -> a") -> str:
    """Over the edges: ``p`` and ``q`` in ``step`` stand for an edge's ends, ``a`` for the sum so far."""
    step = step.replace("p.", f"{ring}[i].").replace("q.", f"{ring}[(i + 1) % size({ring})].")
    return f"aggregate(sequence(0, size({ring}) - 1), {start}, (a, i) -> {step}, {finish})"


def area(ring: str) -> str:
    """Signed by direction; positive against the clock."""
    return _fold(ring, "a + (p.x * q.y - q.x * p.y) / 2")


def circumference(ring: str) -> str:
    return _fold(ring, "a + sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2))")


def box(ring: str) -> tuple[str, str, str, str]:
    of = lambda f, c: f"array_{f}(transform({ring}, p -> p.{c}))"
    return of("min", "x"), of("min", "y"), of("max", "x"), of("max", "y")


def inside_half_open(ring: str, x: str, y: str) -> str:
    """Parity of the edges to the right; an edge holds one of its ends and a point on a right edge is outside."""
    rise = "CASE WHEN abs(q.y - p.y) < 1e-12 THEN 1e-12D ELSE q.y - p.y END"
    hit = f"(p.y > {y}) != (q.y > {y}) AND {x} < p.x + ({y} - p.y) * (q.x - p.x) / ({rise})"
    return f"({_fold(ring, f'a + CASE WHEN {hit} THEN 1 ELSE 0 END', '0')} % 2 = 1)"


def inside_closed(ring: str, x: str, y: str) -> str:
    """Parity with upper ends counted and a point on a right edge inside."""
    hit = f"{y} > least(p.y, q.y) AND {y} <= greatest(p.y, q.y) AND {x} <= greatest(p.x, q.x) AND p.y != q.y AND (p.x = q.x OR {x} <= ({y} - p.y) * (q.x - p.x) / nullif(q.y - p.y, 0) + p.x)"
    return f"({_fold(ring, f'a + CASE WHEN {hit} THEN 1 ELSE 0 END', '0')} % 2 = 1)"


def edge_distance(ring: str, x: str, y: str, tolerance: str = "1e-9") -> str:
    """The largest signed distance from an edge's line (outside positive), of those below the tolerance; 1 if there is none."""
    d = f"(((q.y - p.y) * ({x} - p.x) - (q.x - p.x) * ({y} - p.y)) / sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)))"
    step = f"CASE WHEN {d} < {tolerance} THEN greatest(coalesce(a, {d}), {d}) ELSE a END"
    return _fold(ring, step, "CAST(NULL AS DOUBLE)", "a -> coalesce(a, 1D)")


def moments(ring: str) -> str:
    """Integral of x squared over the polygon, as a quadratic distribution of fibres needs it."""
    return _fold(ring, "a + (p.x * q.y - q.x * p.y) * (p.x * p.x + p.x * q.x + q.x * q.x) / 12")
