"""Paths, weaves and measures of yarns as window functions and grouped sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def along(key: str = "yarn_id", order: str = "node_idx"):
    return Window.partitionBy(key).orderBy(order)


def steps(nodes: DataFrame, key: str = "yarn_id", order: str = "node_idx") -> DataFrame:
    """Adds ``step``, the distance to the node before (0 for the first), and ``arc``, the length so far."""
    w = along(key, order)
    before = [F.lag(c).over(w) for c in "xyz"]
    step = F.sqrt(sum(((F.col(c) - b) ** 2 for c, b in zip("xyz", before, strict=True)), F.lit(0.0)))
    return nodes.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("arc", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def tangents(nodes: DataFrame, key: str = "yarn_id", order: str = "node_idx") -> DataFrame:
    """Adds tx, ty, tz: from the node before to the one behind, of length one; one-sided at the ends."""
    w = along(key, order)
    d = {c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in "xyz"}
    rows = nodes.withColumns({f"d{c}": e for c, e in d.items()})
    size = F.expr("nullif(sqrt(dx * dx + dy * dy + dz * dz), 0)")
    return rows.withColumns({f"t{c}": F.col(f"d{c}") / size for c in "xyz"}).drop("dx", "dy", "dz")


def resample(nodes: DataFrame, n: int, key: str = "yarn_id", order: str = "node_idx") -> DataFrame:
    """n points a yarn at equal distances along its path, ends included."""
    w = along(key, order)
    rows = steps(nodes, key, order).withColumns({f"{c}2": F.lead(c).over(w) for c in ("x", "y", "z", "arc")}).withColumn("total", F.max("arc").over(Window.partitionBy(key)))
    span = rows.where("arc2 > arc")
    want = span.withColumn("j", F.explode(F.expr(f"filter(sequence(0, {n - 1}), j -> j * total / {n - 1} >= arc AND (j * total / {n - 1} < arc2 OR (j = {n - 1} AND arc2 = total)))")))
    u = f"((j * total / {n - 1} - arc) / (arc2 - arc))"
    return want.selectExpr(key, "j", *(f"{c} + ({c}2 - {c}) * {u} AS {c}" for c in "xyz"))


def spline(nodes: DataFrame, key: str = "yarn_id", order: str = "node_idx") -> DataFrame:
    """Second derivatives (mx, my, mz) of the natural cubic spline through each yarn's nodes, by node number.

    The system is tridiagonal, so a fold forth and one back over a yarn's nodes solve it without leaving the JVM.
    """
    last = "coalesce(try_element_at(s, -1).{0}, 0D)"
    pivot = f"(4D - {last.format('c')})"
    forth = ", ".join(f"'{c}', (6 * (p[i + 1].{c} - 2 * p[i].{c} + p[i - 1].{c}) - {last.format(c)}) / {pivot}" for c in "xyz")
    down = f"aggregate(sequence(1, size(p) - 2), CAST(array() AS array<struct<c:double,x:double,y:double,z:double>>), (s, i) -> concat(s, array(named_struct('c', 1D / {pivot}, {forth}))))"
    back = ", ".join(f"'{c}', r.{c} - r.c * coalesce(try_element_at(s, 1).{c}, 0D)" for c in "xyz")
    up = f"aggregate(reverse(d), CAST(array() AS array<struct<x:double,y:double,z:double>>), (s, r) -> concat(array(named_struct({back})), s))"
    end = "array(named_struct('x', 0D, 'y', 0D, 'z', 0D))"
    rows = nodes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "x", "y", "z"))).alias("p"))
    rows = rows.withColumn("d", F.expr(f"CASE WHEN size(p) > 2 THEN {down} END"))
    rows = rows.withColumn("m", F.expr(f"CASE size(p) WHEN 1 THEN {end} WHEN 2 THEN concat({end}, {end}) ELSE concat({end}, {up}, {end}) END"))
    return rows.select(key, F.explode(F.arrays_zip("p", "m")).alias("n")).select(key, f"n.p.{order}", *(F.col(f"n.m.{c}").alias(f"m{c}") for c in "xyz"))


def weave(spark: SparkSession, nx: int, ny: int, spacing: float, thickness: float, swapped=()) -> DataFrame:
    """A two-layer weave of nx warp yarns (along y) and ny weft yarns (along x): a node at each crossing and the
    first again a repeat further. Swapped cells (x, y) have the weft above."""
    cells = spark.range(nx * ny).selectExpr(f"CAST(id % {nx} AS INT) AS cx", f"CAST(id div {nx} AS INT) AS cy")
    up = F.lit(False)
    for x, y in swapped:
        up = up | ((F.col("cx") == x) & (F.col("cy") == y))
    cells = cells.withColumn("weft_up", up)
    level = lambda above: F.when(above, F.lit(thickness / 4)).otherwise(F.lit(-thickness / 4))
    warp = cells.select(F.col("cx").alias("yarn_id"), F.col("cy").alias("node_idx"), (F.col("cx") * spacing).alias("x"), (F.col("cy") * spacing).alias("y"), level(~F.col("weft_up")).alias("z"))
    weft = cells.select((F.col("cy") + nx).alias("yarn_id"), F.col("cx").alias("node_idx"), (F.col("cx") * spacing).alias("x"), (F.col("cy") * spacing).alias("y"), level(F.col("weft_up")).alias("z"))
    ends_warp = warp.where("node_idx = 0").select("yarn_id", F.lit(ny).alias("node_idx"), "x", F.lit(ny * spacing).alias("y"), "z")
    ends_weft = weft.where("node_idx = 0").select("yarn_id", F.lit(nx).alias("node_idx"), F.lit(nx * spacing).alias("x"), "y", "z")
    return warp.unionByName(ends_warp).unionByName(weft).unionByName(ends_weft)


def periodic_images(yarns: DataFrame, repeats: list[tuple[float, float, float]], reach: int = 1) -> DataFrame:
    """Every combination of -reach ... reach times each repeat."""
    rows = yarns.withColumns({"dx": F.lit(0.0), "dy": F.lit(0.0), "dz": F.lit(0.0)})
    for k, r in enumerate(repeats):
        rows = rows.withColumn(f"n{k}", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
        rows = rows.withColumns({f"d{c}": F.col(f"d{c}") + F.col(f"n{k}") * float(v) for c, v in zip("xyz", r, strict=True)})
    return rows


def distinct_materials(rows: DataFrame, key: str, constants: list[str], default: str = "Mat0") -> DataFrame:
    """Material names by first appearance of equal constants; all zeros are the default. Few materials, so one window."""
    kinds = rows.groupBy(*constants).agg(F.min(key).alias("first"))
    zero = F.lit(True)
    for c in constants:
        zero = zero & (F.col(c) == 0)
    named = kinds.withColumn("zero", zero).withColumn("rank", F.row_number().over(Window.partitionBy("zero").orderBy("first")))
    named = named.withColumn("material", F.when(F.col("zero"), default).otherwise(F.concat(F.lit("Mat"), F.col("rank"))))
    return rows.join(named.select(*constants, "material"), constants).select(key, "material")


def layered(models: list[tuple[DataFrame, tuple[float, float, float]]]) -> DataFrame:
    """One model of several layers (yarn_id, node_idx, x, y, z), each moved by its offset; yarns are numbered on."""
    out, first = None, 0
    for layer, (nodes, offset) in enumerate(models):
        moved = nodes.select((F.col("yarn_id") + first).alias("yarn_id"), "node_idx", *((F.col(c) + float(o)).alias(c) for c, o in zip("xyz", offset, strict=True)), F.lit(layer).alias("layer"))
        out = moved if out is None else out.unionByName(moved)
        first += (nodes.agg(F.max("yarn_id")).first()[0] or 0) + 1
    return out


def edit_nodes(nodes: DataFrame, insert: DataFrame | None = None, delete: DataFrame | None = None, replace: DataFrame | None = None) -> DataFrame:
    """Nodes by (yarn_id, node_idx): deleted ones go, replaced ones change, an inserted one stands before the node of
    its number; then they are numbered anew."""
    keys = ["yarn_id", "node_idx"]
    rows = nodes
    if replace is not None:
        rows = rows.join(replace.select(*keys), keys, "left_anti").unionByName(replace)
    if delete is not None:
        rows = rows.join(delete.select(*keys), keys, "left_anti")
    rows = rows.withColumn("place", F.col("node_idx").cast("double"))
    if insert is not None:
        rows = rows.unionByName(insert.withColumn("place", F.col("node_idx") - 0.5))
    number = F.row_number().over(Window.partitionBy("yarn_id").orderBy("place")) - 1
    return rows.withColumn("node_idx", number).drop("place")


def next_filled(cells: DataFrame) -> DataFrame:
    """(row, col, kind) with ``following``: the column of the next cell of the row that isn't empty, round the end."""
    filled = F.when(F.col("kind").isNotNull(), F.col("col"))
    w = Window.partitionBy("row").orderBy("col")
    ahead = F.first(filled, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return cells.withColumn("following", F.coalesce(ahead, F.min(filled).over(Window.partitionBy("row"))))


def weft_knit(spark: SparkSession, wale_height: float, loop_height: float, course_width: float, thickness: float) -> DataFrame:
    """A loop of a weft knit: nine nodes, the right half mirroring the left about the middle of the course."""
    w, t = course_width, thickness
    left = [(0.0, 0.0, t / 2), ((w + 2 * t) / 4, (loop_height - wale_height) / 2, 0.0), (w / 4, loop_height / 2, -t / 2), ((w - 2 * t) / 4, (loop_height + wale_height) / 2, 0.0)]
    loop = [*left, (w / 2, loop_height, t / 2), *((w - x, y, z) for x, y, z in reversed(left))]
    return spark.createDataFrame([(0, i, *p) for i, p in enumerate(loop)], "yarn_id int, node_idx int, x double, y double, z double")


def spline_points(nodes: DataFrame, per_segment: int, key: str = "yarn_id", order: str = "node_idx") -> DataFrame:
    """(key, segment, j, x, y, z, tx, ty, tz) on the natural cubic spline at ``per_segment`` equal steps of each segment's
    parameter, with tangents of length one. A yarn of one node has no segment."""
    w = along(key, order)
    at = nodes.select(key, order, "x", "y", "z").join(spline(nodes, key, order), [key, order])
    ahead = at.select("*", *(F.lead(c).over(w).alias(f"{c}2") for c in ("x", "y", "z", "mx", "my", "mz"))).where("x2 IS NOT NULL")
    rows = ahead.select("*", F.explode(F.sequence(F.lit(0), F.lit(per_segment - 1))).alias("j")).withColumn("t", F.col("j") / F.lit(float(per_segment)))
    place = [f"(1 - t) * {c} + t * {c}2 + (pow(1 - t, 3) - (1 - t)) * m{c} / 6 + (pow(t, 3) - t) * m{c}2 / 6 AS p{c}" for c in "xyz"]
    slope = [f"{c}2 - {c} + (1 - 3 * pow(1 - t, 2)) * m{c} / 6 + (3 * pow(t, 2) - 1) * m{c}2 / 6 AS d{c}" for c in "xyz"]
    found = rows.selectExpr(key, f"{order} AS segment", "j", *place, *slope)
    size = "nullif(sqrt(dx * dx + dy * dy + dz * dz), 0)"
    return found.selectExpr(key, "segment", "j", *(f"p{c} AS {c}" for c in "xyz"), *(f"d{c} / {size} AS t{c}" for c in "xyz"))
