"""Cutting triangles by a half-space, and equations between the faces of a periodic cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.plan import settle

TOLERANCE = 1e-9


def clip_triangles(triangles: DataFrame, normal: tuple[float, float, float], d: float) -> DataFrame:
    """Triangles (tri_id, x0 ... z2) where n . p >= d: (tri_id, part, x0 ... z2), winding kept.

    With one corner inside one smaller triangle stays, with two a quadrangle as two triangles. A corner nearer to
    the plane than the tolerance counts as inside.
    """
    n = [float(v) for v in normal]
    side = lambda k: " + ".join(f"{c}{k} * {v!r}D" for c, v in zip("xyz", n, strict=True)) + f" - {float(d)!r}D"
    rows = settle(triangles, **{f"s{k}": F.expr(side(k)) for k in range(3)})
    inside = [f"(s{k} >= -{TOLERANCE!r}D)" for k in range(3)]
    rows = rows.withColumn("code", F.expr(" + ".join(f"CASE WHEN {p} THEN {1 << k} ELSE 0 END" for k, p in enumerate(inside))))
    corner = lambda k: f"array({', '.join(f'{c}{k}' for c in 'xyz')})"
    cut = lambda a, b: f"array({', '.join(f'{c}{a} + ({c}{b} - {c}{a}) * s{a} / (s{a} - s{b})' for c in 'xyz')})"
    cases = [f"WHEN 7 THEN array(array({corner(0)}, {corner(1)}, {corner(2)}))"]
    for k in range(3):
        a, b = (k + 1) % 3, (k + 2) % 3
        cases.append(f"WHEN {1 << k} THEN array(array({corner(k)}, {cut(k, a)}, {cut(k, b)}))")
        cases.append(f"WHEN {7 - (1 << k)} THEN array(array({corner(a)}, {corner(b)}, {cut(b, k)}), array({corner(a)}, {cut(b, k)}, {cut(a, k)}))")
    made = rows.where("code > 0").select("tri_id", F.posexplode(F.expr(f"CASE code {' '.join(cases)} END")).alias("part", "p"))
    return made.select("tri_id", "part", *(F.col("p")[k][i].alias(f"{c}{k}") for k in range(3) for i, c in enumerate("xyz")))


def areas(triangles: DataFrame) -> DataFrame:
    u, v = [f"({c}1 - {c}0)" for c in "xyz"], [f"({c}2 - {c}0)" for c in "xyz"]
    n = [f"({u[i]} * {v[j]} - {u[j]} * {v[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    return triangles.withColumn("area", F.expr(f"sqrt({' + '.join(f'{p} * {p}' for p in n)}) / 2"))


def periodic_equations(pairs: DataFrame, drivers: tuple[str, str, str]) -> DataFrame:
    """For node pairs (a, b) a period apart: u_b - u_a = driver, a row for each term of each direction."""
    terms = F.expr(f"""flatten(transform(sequence(1, 3), k -> array(
        named_struct('dof', k, 'term', 1, 'node', CAST(b AS STRING), 'factor', 1D),
        named_struct('dof', k, 'term', 2, 'node', CAST(a AS STRING), 'factor', -1D),
        named_struct('dof', k, 'term', 3, 'node', element_at(array({', '.join(repr(d) for d in drivers)}), k), 'factor', -1D))))""")
    return pairs.select("a", "b", F.explode(terms).alias("t")).select("a", "b", "t.dof", "t.term", "t.node", "t.factor")


def number_corners(cells: DataFrame, digits: int = 12) -> tuple[DataFrame, DataFrame]:
    """Nodes and elements of box cells (cell_id, x, y, z, dx, dy, dz): corners at equal rounded places are one node.

    Nodes are known by the cell and corner that shows them first; numbers would need one order over all, and an
    export that wants them orders by that.
    """
    order = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    spots = F.array(*(F.struct(*(F.round(F.col(c) + F.col(f"d{c}") * o, digits).alias(c) for c, o in zip("xyz", place, strict=True))) for place in order))
    rows = cells.select("cell_id", F.posexplode(spots).alias("k", "p"))
    nodes = rows.groupBy("p").agg(F.min(F.col("cell_id") * 8 + F.col("k")).alias("node_id"))
    elements = rows.join(nodes, "p").groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("k", "node_id"))).alias("s")).select("cell_id", F.expr("transform(s, x -> x.node_id)").alias("nodes"))
    return nodes.select("node_id", "p.x", "p.y", "p.z"), elements
