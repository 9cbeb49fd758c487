"""Text forms of meshes and point data, as numbered lines for ``decks.write_lines``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Cell codes of the VTK file format
VTK_CODES = {"LINE": 3, "TRI": 5, "QUAD": 9, "TET": 10, "HEX": 12, "WEDGE": 13, "PYRAMID": 14}


def orientation_lines(points: DataFrame, key: str = "vid") -> DataFrame:
    """An element's number, its direction and the direction across: tangent, and tangent x up, of length one."""
    c = ("(ty * uz - tz * uy)", "(tz * ux - tx * uz)", "(tx * uy - ty * ux)")
    size = f"nullif(sqrt({' + '.join(f'{p} * {p}' for p in c)}), 0)"
    parts = ["tx", "ty", "tz", *(f"coalesce({p} / {size}, 0D)" for p in c)]
    rows = points.selectExpr(f"{key} + 1 AS n", *(f"{p} AS v{i}" for i, p in enumerate(parts)))
    return rows.select(F.col("n").alias("line_no"), F.format_string("%d, %.6f, %.6f, %.6f, %.6f, %.6f, %.6f", "n", *(f"v{i}" for i in range(6))).alias("value"))


def vtk_cells(elements: DataFrame) -> DataFrame:
    """(elem_id, offset, code): the end of each element's nodes in the list of all, and its type's code.

    Ends are sums of sizes within ranges of ids plus the ranges' starts, so no task sees every element.
    """
    width = 65_536
    code = F.lit(None).cast("int")
    for name, number in VTK_CODES.items():
        code = F.when(F.col("type") == name, number).otherwise(code)
    rows = elements.select("elem_id", F.size("nodes").cast("long").alias("n"), code.alias("code"), F.expr(f"elem_id div {width}").alias("range"))
    totals = rows.groupBy("range").agg(F.sum("n").alias("total"))
    starts = totals.withColumn("start", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.sum("n").over(Window.partitionBy("range").orderBy("elem_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("own", own).join(starts.select("range", "start"), "range").selectExpr("elem_id", "start + own AS offset", "code")


def stl_facets(triangles: DataFrame) -> DataFrame:
    """(line_no, value): a facet of text for each triangle (tri_id, x0 ... z2), its normal by the order of its corners."""
    u, v = [f"({c}1 - {c}0)" for c in "xyz"], [f"({c}2 - {c}0)" for c in "xyz"]
    n = [f"({u[i]} * {v[j]} - {u[j]} * {v[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    size = f"nullif(sqrt({' + '.join(f'{p} * {p}' for p in n)}), 0)"
    rows = triangles.selectExpr("*", *(f"coalesce({p} / {size}, 0D) AS n{c}" for p, c in zip(n, "xyz", strict=True)))
    corner = "\n    vertex %.6e %.6e %.6e"
    text = "facet normal %.6e %.6e %.6e\n  outer loop" + corner * 3 + "\n  endloop\nendfacet"
    return rows.select(F.col("tri_id").alias("line_no"), F.format_string(text, "nx", "ny", "nz", *(f"{c}{i}" for i in range(3) for c in "xyz")).alias("value"))


#: Corners of a cell (1 for the far side along x, 2 along y, 4 along z) in the order of each format, and its first node number.
HEX_ORDERS = {"inp": ((1, 3, 2, 0, 5, 7, 6, 4), 1), "scirun": ((0, 1, 4, 5, 2, 3, 6, 7), 1), "vtu": ((0, 1, 5, 4, 2, 3, 7, 6), 0)}


def hex_elements(voxels: DataFrame, shape: tuple[int, int, int], order: str = "inp", matrix: bool = True, yarn: bool = True) -> DataFrame:
    """(elem_id, vid, yarn_id, nodes) of the cells (vid, yarn_id; -1 or null for matrix) of a grid, numbered from 1 without gaps.

    Numbers are places within ranges of ids plus the ranges' starts, so no task sees every cell.
    """
    places, base = HEX_ORDERS[order]
    nx, ny, _ = shape
    ix, iy, iz = f"(vid % {nx})", f"(vid div {nx} % {ny})", f"(vid div {nx * ny})"
    node = lambda k: f"{ix} + {k & 1} + ({iy} + {k >> 1 & 1}) * {nx + 1} + ({iz} + {k >> 2}) * {(nx + 1) * (ny + 1)} + {base}"
    width = 65_536
    kept = voxels.selectExpr("vid", "coalesce(yarn_id, -1) AS yarn_id", f"vid div {width} AS range").where(f"(yarn_id = -1 AND {matrix}) OR (yarn_id >= 0 AND {yarn})".lower())
    totals = kept.groupBy("range").agg(F.count("*").alias("total"))
    starts = totals.select("range", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    numbered = kept.withColumn("own", F.row_number().over(Window.partitionBy("range").orderBy("vid"))).join(starts, "range")
    return numbered.selectExpr("start + own AS elem_id", "vid", "yarn_id", f"array({', '.join(node(k) for k in places)}) AS nodes")


def smesh_lines(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(part, line_no, value) of a surface in SMESH text, to be put in order of part and line_no.

    nodes(node_id from 0, x, y, z); elements(elem_id, type, nodes), of which quads come first and then triangles.
    """
    fixed = lambda part, *text: nodes.sparkSession.createDataFrame([(part, i, t) for i, t in enumerate(text)], "part int, line_no long, value string")
    faces = elements.where(F.col("type").isin("QUAD", "TRI"))
    head = nodes.agg(F.concat(F.count("*").cast("string"), F.lit(" 3 0 0")).alias("value")).select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("line_no"), "value")
    points = nodes.select(F.lit(3).alias("part"), F.col("node_id").cast("long").alias("line_no"), F.format_string("%d %.6g %.6g %.6g", F.col("node_id").cast("long"), "x", "y", "z").alias("value"))
    count = faces.agg(F.concat(F.count("*").cast("string"), F.lit(" 0")).alias("value")).select(F.lit(5).alias("part"), F.lit(0).cast("long").alias("line_no"), "value")
    rows = faces.select(F.when(F.col("type") == "QUAD", 7).otherwise(8).alias("part"), F.col("elem_id").cast("long").alias("line_no"), F.concat_ws(" ", F.size("nodes").cast("string"), F.array_join(F.transform("nodes", lambda i: i.cast("string")), " ")).alias("value"))
    text = (
        fixed(0, "# node count, 3 dim, no attribute, no boundary marker"),
        head,
        fixed(2, "# node index, node coordinates"),
        points,
        fixed(4, "# facet count, no boundary marker"),
        count,
        fixed(6, "# facets"),
        rows,
        fixed(9, "# Part 3 - hole list", "0 # no hole", "# Part 4 - region list", "0 # no region"),
    )
    out = text[0]
    for part in text[1:]:
        out = out.unionByName(part)
    return out


def material_lines(materials: DataFrame, sections: DataFrame) -> DataFrame:
    """(name, line_no, value): elastic and expansion cards of each material, and of ``sections`` (yarn_id, material; -1 for the matrix) their cards.

    materials(name, elastic array, expansion array): two elastic constants are isotropic and so is one of expansion.
    Eight values go to a line. Sections have the empty name and are numbered by their yarn.
    """
    values = lambda c: f"transform(sequence(0, (size({c}) - 1) div 8), i -> array_join(transform(slice({c}, i * 8 + 1, 8), v -> CAST(v AS STRING)), ', '))"
    elastic = "CASE WHEN size(elastic) = 2 THEN '*Elastic' ELSE '*Elastic, type=ENGINEERING CONSTANTS' END"
    expansion = "CASE WHEN size(expansion) = 1 THEN '*Expansion' ELSE '*Expansion, type=ORTHO' END"
    cards = F.expr(f"concat(array(concat('*Material, Name=', name), {elastic}), {values('elastic')}, array({expansion}), {values('expansion')})")
    top = materials.select("name", F.posexplode(cards).alias("line_no", "value"))
    low = sections.selectExpr("'' AS name", "yarn_id", "CASE WHEN yarn_id = -1 THEN concat('*Solid Section, ElSet=Matrix, Material=', material) ELSE concat('*Solid Section, ElSet=Yarn', yarn_id, ', Material=', material, ', Orientation=Orientations') END AS card")
    low = low.select("name", F.posexplode(F.expr("array(card, '1.0,')")).alias("k", "value"), "yarn_id").selectExpr("name", "CAST((yarn_id + 1) * 2 + k AS INT) AS line_no", "value")
    return top.unionByName(low)


#: Element types of a mixed deck in the order they are written, with their names there.
DECK_TYPES = {"TET": "C3D4", "WEDGE": "C3D6", "HEX": "C3D8R", "QUADRATIC_TET": "C3D10", "QUAD": "S4R"}


def mixed_elements(elements: DataFrame) -> DataFrame:
    """(number, kind, nodes) of a mesh (elem_id, type, nodes from 0), numbered from 1 type by type, nodes from 1.

    A wedge's two triangles change places, as the deck counts them from the other side. Other types are left out.
    Numbers are places within ranges of ids plus the ranges' starts.
    """
    width = 65_536
    place = F.create_map(*(F.lit(v) for i, t in enumerate(DECK_TYPES) for v in (t, i)))
    kind = F.create_map(*(F.lit(v) for pair in DECK_TYPES.items() for v in pair))
    rows = elements.where(F.col("type").isin(*DECK_TYPES)).select("elem_id", place[F.col("type")].alias("at"), kind[F.col("type")].alias("kind"), F.expr(f"elem_id div {width}").alias("range"), F.expr("transform(CASE WHEN type = 'WEDGE' THEN concat(slice(nodes, 4, 3), slice(nodes, 1, 3)) ELSE nodes END, n -> n + 1)").alias("nodes"))
    totals = rows.groupBy("at", "range").agg(F.count("*").alias("total"))
    before = F.sum("total").over(Window.orderBy("at", "range").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("at", "range", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("at", "range").orderBy("elem_id"))
    return rows.withColumn("own", own).join(starts, ["at", "range"]).select((F.col("start") + F.col("own")).alias("number"), "kind", "nodes")


def matrix_set_lines(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """(line_no, value): the sets of all elements and of all nodes of a grid that is matrix only, as ranges."""
    nx, ny, nz = shape
    text = ("*ElSet, ElSet=Matrix, Generate", f"1, {nx * ny * nz}, 1", "*NSet, NSet=AllNodes, Generate", f"1, {(nx + 1) * (ny + 1) * (nz + 1)}, 1")
    return spark.createDataFrame(list(enumerate(text)), "line_no int, value string")
