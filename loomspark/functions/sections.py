"""Points of yarn cross-sections by parameter t in [0, 1): pairs of SQL expressions."""

from __future__ import annotations

from collections.abc import Callable

TURN = "(2 * pi() * ({t}))"


def ellipse(w: str, h: str, t: str) -> tuple[str, str]:
    turn = TURN.format(t=t)
    return f"(0.5 * {w} * cos({turn}))", f"(0.5 * {h} * sin({turn}))"


def power_ellipse(w: str, h: str, power: str, t: str, shift: str = "0.0") -> tuple[str, str]:
    """The half towards +x is narrowed, and the other widened, by the shift."""
    turn = TURN.format(t=t)
    side = f"CASE WHEN {t} <= 0.25 OR {t} >= 0.75 THEN 0.5 * {w} - {shift} ELSE 0.5 * {w} + {shift} END"
    rise = f"sign(sin({turn})) * pow(abs(sin({turn})), {power})"
    return f"(({side}) * cos({turn}) + {shift})", f"(0.5 * {h} * ({rise}))"


def lenticular(w: str, h: str, t: str, distortion: str = "0.0") -> tuple[str, str]:
    """Two arcs through the section's ends; an arc without height is a line."""
    upper = f"({t} < 0.5)"
    high = f"(CASE WHEN {upper} THEN {h} - 2 * {distortion} ELSE {h} + 2 * {distortion} END)"
    radius = f"(({w} * {w} + {high} * {high}) / (4 * {high}))"
    angle = f"((CASE WHEN {upper} THEN 1 - 4 * {t} ELSE 4 * {t} - 3 END) * asin(0.5 * {w} / {radius}))"
    turned = f"(CASE WHEN {upper} THEN 1 ELSE -1 END)"
    flat = f"abs({high}) < 1e-9"
    x = f"(CASE WHEN {flat} THEN 0.5 * {w} - 2 * (CASE WHEN {upper} THEN {t} ELSE 1 - {t} END) * {w} ELSE {radius} * sin({angle}) END)"
    y = f"(CASE WHEN {flat} THEN {turned} * 0.5 * {h} ELSE {turned} * ({radius} * cos({angle}) - ({radius} - 0.5 * {h})) END)"
    return x, y


def rectangle(w: str, h: str, t: str) -> tuple[str, str]:
    """Round the outline from the middle of the right side, by length."""
    s = f"(({t}) * 2 * ({w} + {h}))"
    corners = (f"({h} / 2)", f"({h} / 2 + {w})", f"(1.5 * {h} + {w})", f"(1.5 * {h} + 2 * {w})")
    x = f"(CASE WHEN {s} <= {corners[0]} THEN {w} / 2 WHEN {s} <= {corners[1]} THEN {w} / 2 - ({s} - {corners[0]}) WHEN {s} <= {corners[2]} THEN -{w} / 2 WHEN {s} <= {corners[3]} THEN {s} - {corners[2]} - {w} / 2 ELSE {w} / 2 END)"
    y = f"(CASE WHEN {s} <= {corners[0]} THEN {s} WHEN {s} <= {corners[1]} THEN {h} / 2 WHEN {s} <= {corners[2]} THEN {h} / 2 - ({s} - {corners[1]}) WHEN {s} <= {corners[3]} THEN -{h} / 2 ELSE {s} - 2 * ({w} + {h}) END)"
    return x, y


def rotated(point: tuple[str, str], angle: str) -> tuple[str, str]:
    x, y = point
    return f"({x} * cos({angle}) - {y} * sin({angle}))", f"({x} * sin({angle}) + {y} * cos({angle}))"


def scaled(point: tuple[str, str], sx: str, sy: str) -> tuple[str, str]:
    return f"({point[0]} * {sx})", f"({point[1]} * {sy})"


def hybrid(parts: list[tuple[str, tuple[str, str]]]) -> tuple[str, str]:
    """(upper limit of t, point) in order; the last takes the rest."""
    pick = lambda k: "(CASE " + " ".join(f"WHEN {limit} THEN {point[k]}" for limit, point in parts[:-1]) + f" ELSE {parts[-1][1][k]} END)"
    return pick(0), pick(1)


def between(a: tuple[str, str], b: tuple[str, str], u: str, smooth: bool = False) -> tuple[str, str]:
    v = f"(3 * {u} * {u} - 2 * {u} * {u} * {u})" if smooth else f"({u})"
    return f"({a[0]} + ({b[0]} - {a[0]}) * {v})", f"({a[1]} + ({b[1]} - {a[1]}) * {v})"


def bezier(points: str, t: str) -> tuple[str, str]:
    """A closed outline of cubics: ``points`` is an array of (x, y), three to a curve, and the last curve ends at the first point."""
    count = f"(size({points}) div 3)"
    index = f"least(CAST(floor({t} * {count}) AS INT), {count} - 1)"
    u = f"least({t} * {count} - {index}, 1D)"
    at = lambda k, c: f"{points}[({index} * 3 + {k}) % size({points})].{c}"
    curve = lambda c: f"(pow(1 - {u}, 3) * {at(0, c)} + 3 * pow(1 - {u}, 2) * {u} * {at(1, c)} + 3 * (1 - {u}) * pow({u}, 2) * {at(2, c)} + pow({u}, 3) * {at(3, c)})"
    return curve("x"), curve("y")


def sample(point: Callable[[str], tuple[str, str]], n: int) -> str:
    """``n`` points of an outline at equal steps of its parameter, as an array of (x, y)."""
    x, y = point(f"(i / {n}D)")
    return f"transform(sequence(0, {n - 1}), i -> named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE)))"


def equally_spaced(point: Callable[[str], tuple[str, str]], n: int, rounds: int = 1000, tolerance: float = 1e-12) -> str:
    """``n`` points of an outline at equal distances, as an array of (x, y); equal steps of the parameter if none are found.

    Each step of the parameter is scaled by the mean distance over its own, until the distances' variance is under
    the tolerance; two points in one place end the search. A fold inside the JVM: rounds after the last needed one only pass the state on.
    """
    x, y = point("t")
    starts = "transform(sequence(0, size(s.w) - 1), k -> aggregate(slice(s.w, 1, k), 0D, (a, v) -> a + v))"
    ring = f"transform({starts}, t -> named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE)))"
    apart = f"transform(sequence(0, {n - 1}), i -> sqrt(pow(r[i].x - r[(i + 1) % {n}].x, 2) + pow(r[i].y - r[(i + 1) % {n}].y, 2)))"
    mean = f"(aggregate(d, 0D, (a, v) -> a + v) / {n})"
    # ``transform(array(v), name -> ...)[0]`` names a value that is used more than once.
    step = (
        f"transform(array({ring}), r -> transform(array({apart}), d -> transform(array({mean}), m -> named_struct("
        f"'w', zip_with(s.w, d, (w, v) -> try_divide(w * m, v)), 'ring', r, 'done', CASE WHEN NOT exists(d, v -> v = 0) THEN aggregate(d, 0D, (a, v) -> a + (v - m) * (v - m)) / {n} < {tolerance}D END))[0])[0])[0]"
    )
    scaled_ = "named_struct('w', transform(z.w, v -> v / aggregate(z.w, 0D, (a, b) -> a + b)), 'ring', z.ring, 'done', z.done)"
    start = f"named_struct('w', transform(sequence(1, {n}), i -> 1D / {n}), 'ring', {sample(point, n)}, 'done', false)"
    fold = f"aggregate(sequence(1, {rounds}), {start}, (s, j) -> CASE WHEN s.done OR s.done IS NULL THEN s ELSE transform(array({step}), z -> {scaled_})[0] END, s -> CASE WHEN s.done THEN s.ring END)"
    return f"coalesce({fold}, {sample(point, n)})"
