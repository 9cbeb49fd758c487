"""Vector algebra as SQL expressions.

A vector is a triple of SQL expressions; every function gives expressions again, so whole formulas stay inside one
generated stage, without structs to build or take apart. ``column`` makes a Column of one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[str, str, str]


def column(expression: str, digits: int | None = None) -> Column:
    return F.expr(f"round({expression}, {digits})" if digits is not None else expression)


def vec(prefix: str) -> Vec:
    return (f"{prefix}x", f"{prefix}y", f"{prefix}z")


def _each(op: str, a: Vec, b: Vec) -> Vec:
    return tuple(f"({p} {op} {q})" for p, q in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return _each("+", a, b)


def sub(a: Vec, b: Vec) -> Vec:
    return _each("-", a, b)


def mul(a: Vec, b: Vec) -> Vec:
    return _each("*", a, b)


def scale(a: Vec, s: str) -> Vec:
    return tuple(f"({p} * ({s}))" for p in a)


def dot(a: Vec, b: Vec) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b, strict=True)) + ")"


def cross(a: Vec, b: Vec) -> Vec:
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def length(a: Vec) -> str:
    return f"sqrt({dot(a, a)})"


def normalise(a: Vec) -> Vec:
    """Null where the vector is zero."""
    return tuple(f"({p} / nullif({length(a)}, 0))" for p in a)


def least(a: Vec, b: Vec) -> Vec:
    return tuple(f"least({p}, {q})" for p, q in zip(a, b, strict=True))


def greatest(a: Vec, b: Vec) -> Vec:
    return tuple(f"greatest({p}, {q})" for p, q in zip(a, b, strict=True))


def quaternion(axis: Vec, angle: str) -> tuple[str, str, str, str]:
    n = normalise(axis)
    return (f"cos(({angle}) / 2)", *(f"({p} * sin(({angle}) / 2))" for p in n))


def rotate(q: tuple[str, str, str, str], v: Vec) -> Vec:
    """v + 2w(u x v) + 2u x (u x v) for the quaternion (w, u)."""
    u = q[1:]
    t = scale(cross(u, v), "2")
    return add(add(v, scale(t, q[0])), cross(u, t))


def closest_on_line(p: Vec, a: Vec, b: Vec) -> tuple[str, Vec]:
    """(parameter, point) on the line through a and b."""
    d = sub(b, a)
    t = f"({dot(sub(p, a), d)} / nullif({dot(d, d)}, 0))"
    return t, add(a, scale(d, t))


def segment_distance(p: Vec, a: Vec, b: Vec) -> str:
    d = sub(b, a)
    t = f"least(1.0, greatest(0.0, {dot(sub(p, a), d)} / nullif({dot(d, d)}, 0)))"
    return length(sub(p, add(a, scale(d, t))))


def line_plane(a: Vec, b: Vec, origin: Vec, normal: Vec) -> tuple[str, Vec]:
    """(parameter, point) where the line through a and b meets the plane; null if it is parallel."""
    u = f"({dot(normal, sub(origin, a))} / nullif({dot(normal, sub(b, a))}, 0))"
    return u, add(a, scale(sub(b, a), u))


def triangle_distance(p: Vec, a: Vec, b: Vec, c: Vec) -> str:
    """Distance from the plane where the foot lies inside the triangle, else from the nearest edge."""
    n = cross(sub(b, a), sub(c, a))
    inside = " AND ".join(f"{dot(cross(sub(q, o), sub(p, o)), n)} >= 0" for o, q in ((a, b), (b, c), (c, a)))
    edges = ", ".join(segment_distance(p, o, q) for o, q in ((a, b), (b, c), (c, a)))
    return f"CASE WHEN {inside} THEN abs({dot(sub(p, a), n)}) / {length(n)} ELSE least({edges}) END"


def circumcentre(a: Vec, b: Vec, c: Vec) -> Vec:
    u, v = sub(b, a), sub(c, a)
    n = cross(u, v)
    part = add(scale(cross(n, u), dot(v, v)), scale(cross(v, n), dot(u, u)))
    return add(a, scale(part, f"1 / nullif(2 * {dot(n, n)}, 0)"))


def barycentric(p: Vec, a: Vec, b: Vec, c: Vec) -> Vec:
    """In the xy plane; zeros for a triangle without area."""
    area = f"(({b[1]} - {c[1]}) * ({a[0]} - {c[0]}) + ({c[0]} - {b[0]}) * ({a[1]} - {c[1]}))"
    u = f"((({b[1]} - {c[1]}) * ({p[0]} - {c[0]}) + ({c[0]} - {b[0]}) * ({p[1]} - {c[1]})) / {area})"
    v = f"((({c[1]} - {a[1]}) * ({p[0]} - {c[0]}) + ({a[0]} - {c[0]}) * ({p[1]} - {c[1]})) / {area})"
    flat = f"abs({area}) < 1e-6"
    return (f"CASE WHEN {flat} THEN 0.0 ELSE {u} END", f"CASE WHEN {flat} THEN 0.0 ELSE {v} END", f"CASE WHEN {flat} THEN 0.0 ELSE 1 - {u} - {v} END")


def bezier(p: tuple[Vec, Vec, Vec, Vec], t: str) -> Vec:
    w = (f"pow(1 - {t}, 3)", f"3 * {t} * pow(1 - {t}, 2)", f"3 * pow({t}, 2) * (1 - {t})", f"pow({t}, 3)")
    return tuple("(" + " + ".join(f"{w[k]} * {p[k][i]}" for k in range(4)) + ")" for i in range(3))


def bezier_tangent(p: tuple[Vec, Vec, Vec, Vec], t: str) -> Vec:
    w = (f"3 * pow(1 - {t}, 2)", f"6 * {t} * (1 - {t})", f"3 * pow({t}, 2)")
    return tuple("(" + " + ".join(f"{w[k]} * ({p[k + 1][i]} - {p[k][i]})" for k in range(3)) + ")" for i in range(3))


def path_linear(a: Vec, b: Vec, t: str) -> Vec:
    return add(a, scale(sub(b, a), t))


def path_bezier(a: Vec, tangent_a: Vec, b: Vec, tangent_b: Vec, t: str) -> Vec:
    """Between two nodes of a path: handles stand a third of the chord along the tangents."""
    third = f"{length(sub(b, a))} / 3"
    return bezier((a, add(a, scale(tangent_a, third)), sub(b, scale(tangent_b, third)), b), t)


def transformed(rows: tuple[Vec, Vec, Vec], v: Vec) -> Vec:
    """The product of a matrix, given by rows, and a vector."""
    return tuple(dot(row, v) for row in rows)


def determinant(rows: tuple[Vec, Vec, Vec]) -> str:
    return dot(rows[0], cross(rows[1], rows[2]))


def inverse(rows: tuple[Vec, Vec, Vec]) -> tuple[Vec, Vec, Vec]:
    """Rows of the inverse; null where there is none."""
    a, b, c = rows
    columns = cross(b, c), cross(c, a), cross(a, b)
    return tuple(tuple(f"({column[i]} / nullif({determinant(rows)}, 0))" for column in columns) for i in range(3))


def round_half_away(x: str) -> str:
    return f"CAST(sign({x}) * floor(abs({x}) + 0.5) AS INT)"


def frame(tangent: Vec, up: Vec) -> tuple[Vec, Vec]:
    """(up at right angles to the tangent, side); ``tangent`` has length one."""
    flat = normalise(sub(up, scale(tangent, dot(tangent, up))))
    return flat, cross(tangent, flat)


def tet_volume(a: Vec, b: Vec, c: Vec, d: Vec) -> str:
    return f"({dot(cross(sub(b, a), sub(c, a)), sub(d, a))} / 6)"


# Spheres, boxes, planes


def in_box(p: Vec, lo: Vec, hi: Vec, tolerance: str = "0") -> str:
    return "(" + " AND ".join(f"{x} >= {a} - {tolerance} AND {x} <= {b} + {tolerance}" for x, a, b in zip(p, lo, hi, strict=True)) + ")"


def boxes_meet(lo1: Vec, hi1: Vec, lo2: Vec, hi2: Vec, tolerance: str = "0") -> str:
    return "(" + " AND ".join(f"{a} <= {d} + {tolerance} AND {c} <= {b} + {tolerance}" for a, b, c, d in zip(lo1, hi1, lo2, hi2, strict=True)) + ")"


def inside_plane(p: Vec, normal: Vec, d: str, tolerance: str = "1e-9") -> str:
    return f"({dot(p, normal)} - ({d}) >= {tolerance})"


def spheres_meet(a: Vec, ra: str, b: Vec, rb: str) -> str:
    d = sub(a, b)
    return f"({dot(d, d)} <= pow({ra} + {rb}, 2))"


def in_triangle_2d(p: Vec, a: Vec, b: Vec, c: Vec) -> str:
    side = lambda o, q: f"(({q[0]} - {o[0]}) * ({p[1]} - {o[1]}) - ({q[1]} - {o[1]}) * ({p[0]} - {o[0]}))"
    s = [side(a, b), side(b, c), side(c, a)]
    return f"(({s[0]} >= 0 AND {s[1]} >= 0 AND {s[2]} >= 0) OR ({s[0]} <= 0 AND {s[1]} <= 0 AND {s[2]} <= 0))"
