"""Relational algebra of meshes: nodes (node_id, x, y, z) and elements (elem_id, nodes array<long>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import vec
from loomspark.operators.plan import settle
from loomspark.session import ensure_checkpoint_dir


def corners(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """A row for each element and place: elem_id, k, node_id, x, y, z."""
    return elements.select("elem_id", F.posexplode("nodes").alias("k", "node_id")).join(nodes, "node_id")


def box(nodes: DataFrame, grow: float = 0.0) -> DataFrame:
    return nodes.agg(*(F.expr(f"min({c}) - {grow}D").alias(f"lo_{c}") for c in "xyz"), *(F.expr(f"max({c}) + {grow}D").alias(f"hi_{c}") for c in "xyz"))


def approximate_size(nodes: DataFrame) -> DataFrame:
    """The diagonal of the box that holds all nodes and the origin."""
    side = " + ".join(f"pow(greatest(0D, max({c})) - least(0D, min({c})), 2)" for c in "xyz")
    return nodes.agg(F.expr(f"sqrt({side})").alias("size"))


def centroids(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    return corners(nodes, elements).groupBy("elem_id").agg(*(F.avg(c).alias(c) for c in "xyz"))


def volume(nodes: DataFrame, triangles: DataFrame) -> DataFrame:
    """Of a closed surface: a sixth of the sum of triple products."""
    at = corners(nodes, triangles).groupBy("elem_id").agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{p}{c}") for k, p in enumerate("amc") for c in "xyz"))
    triple = vec.dot(vec.vec("a"), vec.cross(vec.vec("m"), vec.vec("c")))
    return at.agg(F.expr(f"sum({triple}) / 6").alias("volume"))


def _behind(rows: DataFrame, id_: str) -> int:
    """The number behind the largest id; 0 without rows."""
    largest = rows.agg(F.max(id_)).first()[0]
    return 0 if largest is None else largest + 1


def concatenate(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One mesh of several; ids move up by the largest before them."""
    nodes = elements = None
    n_off = e_off = 0
    for n, e in parts:
        moved = n.withColumn("node_id", F.col("node_id") + n_off)
        shifted = e.select((F.col("elem_id") + e_off).alias("elem_id"), F.expr(f"transform(nodes, i -> i + {n_off}L)").alias("nodes"))
        nodes = moved if nodes is None else nodes.unionByName(moved)
        elements = shifted if elements is None else elements.unionByName(shifted)
        n_off += _behind(n, "node_id")
        e_off += _behind(e, "elem_id")
    return nodes, elements


def unreferenced(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    return nodes.join(elements.select(F.explode("nodes").alias("node_id")).distinct(), "node_id", "left_anti")


def drop_duplicates(elements: DataFrame, ordered: bool = False, last: bool = False) -> DataFrame:
    """One of the elements on the same nodes, in any order or in the same; the first, or the last for lines."""
    key = F.col("nodes") if ordered else F.array_sort("nodes")
    pick = F.max if last else F.min
    return elements.groupBy(key.alias("key")).agg(pick(F.struct("elem_id", "nodes")).alias("e")).select("e.elem_id", "e.nodes")


def drop_degenerate(elements: DataFrame) -> DataFrame:
    return elements.where(F.size(F.array_distinct("nodes")) == F.size("nodes"))


def _turned(nodes: str = "nodes") -> Column:
    """Rotated so that the least id comes first."""
    at = f"array_position({nodes}, array_min({nodes})) - 1"
    return F.expr(f"concat(slice({nodes}, CAST({at} AS INT) + 1, size({nodes})), slice({nodes}, 1, CAST({at} AS INT)))")


def cancel_opposing(elements: DataFrame) -> DataFrame:
    """Faces on the same nodes with opposite winding go in pairs."""
    rows = settle(elements, turned=_turned())
    rows = settle(rows, other=F.expr("concat(slice(turned, 1, 1), reverse(slice(turned, 2, size(turned) - 1)))"))
    rows = settle(rows, key=F.when(F.col("turned") < F.col("other"), F.col("turned")).otherwise(F.col("other")), way=F.col("turned") < F.col("other")).drop("turned", "other")
    counts = rows.groupBy("key").agg(F.sum(F.col("way").cast("int")).alias("forth"), F.sum((~F.col("way")).cast("int")).alias("back"))
    rank = F.row_number().over(Window.partitionBy("key", "way").orderBy("elem_id"))
    return rows.withColumn("rank", rank).join(counts, "key").where("rank > least(forth, back)").select("elem_id", "nodes")


def odd_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b) that are added an odd number of times: each meeting cancels."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n")).where("n % 2 = 1").select("a", "b")


#: Faces of an eight-node element by place.
HEX_FACES = ((0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7))


def faces(hexes: DataFrame) -> DataFrame:
    every = F.array(*(F.array(*(F.col("nodes")[k] for k in face)) for face in HEX_FACES))
    return hexes.select("elem_id", F.posexplode(every).alias("face", "nodes"))


def external_faces(hexes: DataFrame) -> DataFrame:
    """Faces that one element alone has."""
    return faces(hexes).groupBy(F.array_sort("nodes").alias("key")).agg(F.count("*").alias("n"), F.min(F.struct("elem_id", "face")).alias("of")).where("n = 1").select("of.elem_id", "of.face", "key")


def interface_nodes(elements: DataFrame) -> DataFrame:
    """Nodes of elements (elem_id, nodes, yarn_id) of more than one yarn, and of which."""
    owned = elements.select(F.explode("nodes").alias("node_id"), "yarn_id")
    return owned.groupBy("node_id").agg(F.array_sort(F.collect_set("yarn_id")).alias("yarns")).where(F.size("yarns") > 1)


def near_pairs(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """(a, b, d2): points of both sides nearer than the tolerance, by an equi-join over cells of that size.

    The left point asks its own cell and the 26 around it; the right one stands in its own.
    """
    cell = lambda c: f"CAST(floor({c} / {tolerance!r}D) AS BIGINT)"
    around = F.expr(f"""flatten(transform(sequence({cell('x')} - 1, {cell('x')} + 1), i -> flatten(transform(sequence({cell('y')} - 1, {cell('y')} + 1), j ->
        transform(sequence({cell('z')} - 1, {cell('z')} + 1), k -> named_struct('i', i, 'j', j, 'k', k))))))""")
    asked = left.select(F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), F.explode(around).alias("c")).select("a", "ax", "ay", "az", "c.i", "c.j", "c.k")
    stand = right.select(F.col("node_id").alias("b"), "x", "y", "z", *(F.expr(cell(c)).alias(n) for c, n in zip("xyz", "ijk", strict=True)))
    return asked.join(stand, ["i", "j", "k"]).withColumn("d2", F.expr("pow(ax - x, 2) + pow(ay - y, 2) + pow(az - z, 2)")).where(f"d2 < {tolerance * tolerance!r}D").select("a", "b", "d2")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) by alternating star contractions; see Kiveris et al., 2014."""
    ensure_checkpoint_dir(edges.sparkSession)
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct().checkpoint()
    for _ in range(rounds):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        met = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        after = met.select("u", F.col("m").alias("v")).unionAll(met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct().checkpoint()
        same = after.exceptAll(links).isEmpty() and links.exceptAll(after).isEmpty()
        links = after
        if same:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    raise RuntimeError("components didn't settle")


def merge_nodes(nodes: DataFrame, tolerance: float) -> DataFrame:
    """(node_id, kept): chains of nodes nearer than the tolerance become the lowest id among them."""
    pairs = near_pairs(nodes, nodes, tolerance).where("a < b")
    found = components(pairs)
    return nodes.join(found, nodes.node_id == found.node, "left").select("node_id", F.coalesce("root", "node_id").alias("kept"))


def remap(elements: DataFrame, mapping: DataFrame) -> DataFrame:
    """Elements over the kept nodes of ``mapping`` (node_id, kept)."""
    rows = elements.select("elem_id", F.posexplode("nodes").alias("k", "node_id")).join(mapping, "node_id")
    return rows.groupBy("elem_id").agg(F.array_sort(F.collect_list(F.struct("k", "kept"))).alias("s")).select("elem_id", F.expr("transform(s, x -> x.kept)").alias("nodes"))


def translated_pairs(nodes: DataFrame, shift: tuple[float, float, float], tolerance: float) -> DataFrame:
    """(a, b): each node and the first that lies at it plus the shift."""
    moved = nodes.select("node_id", *(F.expr(f"{c} + {float(s)!r}D").alias(c) for c, s in zip("xyz", shift, strict=True)))
    return near_pairs(moved, nodes, tolerance).groupBy("a").agg(F.min("b").alias("b"))


def nearest(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """(a, b, d2): the nearest right node of each left one within the tolerance; the lower id of two as near."""
    return near_pairs(left, right, tolerance).groupBy("a").agg(F.min(F.struct("d2", "b")).alias("m")).select("a", "m.b", "m.d2")


def tributary_areas(nodes: DataFrame, triangles: DataFrame) -> DataFrame:
    """A third of the area of the triangles round each node."""
    at = corners(nodes, triangles).groupBy("elem_id").agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{p}{c}") for k, p in enumerate("amc") for c in "xyz"))
    area = vec.length(vec.cross(vec.sub(vec.vec("m"), vec.vec("a")), vec.sub(vec.vec("c"), vec.vec("a"))))
    sized = at.select("elem_id", F.expr(f"{area} / 6").alias("third"))
    return triangles.select("elem_id", F.explode("nodes").alias("node_id")).join(sized, "elem_id").groupBy("node_id").agg(F.sum("third").alias("area"))


#: How elements are cut: (type of the part, places of its nodes). Corners and their order belong to the element types.
SPLITS = {
    "hex_to_wedge": (("WEDGE", (4, 5, 6, 0, 1, 2)), ("WEDGE", (6, 7, 4, 2, 3, 0))),
    "wedge_to_tet_and_pyramid": (("TET", (3, 4, 5, 2)), ("PYRAMID", (0, 1, 4, 3, 2))),
    "pyramid_to_tet": (("TET", (1, 2, 3, 4)), ("TET", (3, 0, 1, 4))),
    "quad_to_triangle": (("TRI", (0, 1, 2)), ("TRI", (0, 2, 3))),
    "hex_to_quad": tuple(("QUAD", f) for f in ((3, 2, 1, 0), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7), (4, 5, 6, 7))),
    "wedge_to_surface": (("TRI", (0, 1, 2)), ("QUAD", (1, 0, 3, 4)), ("QUAD", (2, 1, 4, 5)), ("QUAD", (0, 2, 5, 3)), ("TRI", (5, 4, 3))),
    "pyramid_to_surface": (("QUAD", (3, 2, 1, 0)), ("TRI", (0, 1, 4)), ("TRI", (1, 2, 4)), ("TRI", (2, 3, 4)), ("TRI", (3, 0, 4))),
    "tet_to_triangle": tuple(("TRI", f) for f in ((2, 1, 0), (0, 1, 3), (1, 2, 3), (2, 0, 3))),
    "triangle_to_segment": (("LINE", (0, 1)), ("LINE", (1, 2)), ("LINE", (2, 0))),
}
#: Cuts along the other diagonal, from node 0 to 2 or from 1 to 3.
_ALONG_02 = {"pyramid_to_tet": (("TET", (0, 1, 2, 4)), ("TET", (0, 2, 3, 4))), "quad_to_triangle": SPLITS["quad_to_triangle"]}
_ALONG_13 = {"pyramid_to_tet": SPLITS["pyramid_to_tet"], "quad_to_triangle": (("TRI", (1, 2, 3)), ("TRI", (3, 0, 1)))}
#: Cuts that are two, one behind the other: the first one's parts of a type are cut by the second.
CHAINS = {"wedge_to_tet": ("wedge_to_tet_and_pyramid", "PYRAMID", "pyramid_to_tet"), "hex_to_tet": ("hex_to_wedge", "WEDGE", "wedge_to_tet")}


def _cut(splits) -> str:
    """SQL of an element's parts, from its ``nodes``."""
    return "array(" + ", ".join(f"named_struct('type', '{kind}', 'nodes', array({', '.join(f'nodes[{k}]' for k in part)}))" for kind, part in splits) + ")"


def split(elements: DataFrame, how: str, nodes: DataFrame | None = None) -> DataFrame:
    """(elem_id, part, type, nodes) of elements (elem_id, nodes), by one of SPLITS or CHAINS; parts are numbered within an element.

    With ``nodes`` (node_id, x, y, z) pyramids and quads are cut along the shorter one of their diagonals (from 1 to 3 if both are equal).
    """
    if how in CHAINS:
        first, kind, second = CHAINS[how]
        rows = split(elements, first, nodes).withColumn("path", F.struct("elem_id", "part"))
        further = split(rows.where(F.col("type") == kind).select(F.col("path").alias("elem_id"), "nodes"), second, nodes)
        whole = rows.where(F.col("type") != kind).select("path", F.lit(-1).alias("own"), "type", "nodes")
        both = whole.unionByName(further.select(F.col("elem_id").alias("path"), F.col("part").alias("own"), "type", "nodes"))
        # an element has a handful of parts: they are put in order within its own row
        ordered = both.groupBy(F.col("path.elem_id").alias("elem_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("path.part").alias("part"), "own", "type", "nodes"))).alias("parts"))
        return ordered.select("elem_id", F.posexplode("parts").alias("part", "p")).select("elem_id", "part", "p.type", "p.nodes")
    if nodes is None or how not in _ALONG_02:
        return elements.select("elem_id", F.posexplode(F.expr(_cut(SPLITS[how]))).alias("part", "p")).select("elem_id", "part", "p.type", "p.nodes")
    ends = elements.select("elem_id", "nodes", F.posexplode(F.slice("nodes", 1, 4)).alias("k", "node_id")).join(nodes, "node_id")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    length = lambda i, j: sum((at(i, c) - at(j, c)) * (at(i, c) - at(j, c)) for c in "xyz")
    shorter = ends.groupBy("elem_id").agg(F.first("nodes").alias("nodes"), (length(0, 2) < length(1, 3)).alias("along_02"))
    parts = F.when(F.col("along_02"), F.expr(_cut(_ALONG_02[how]))).otherwise(F.expr(_cut(_ALONG_13[how])))
    return shorter.select("elem_id", F.posexplode(parts).alias("part", "p")).select("elem_id", "part", "p.type", "p.nodes")


def most_common(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """(group, value): the most frequent value; of several the one that comes first by ``order``, and then the least."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*group).agg(F.min(F.struct(-F.col("n"), "first", F.col(value).alias("value"))).alias("m")).select(*group, "m.value")


def owners_of_faces(surface: DataFrame, elements: DataFrame) -> DataFrame:
    """(face_id, elem_id): the first element that holds all nodes of each face (face_id, nodes)."""
    wanted = surface.select("face_id", F.size("nodes").alias("n"), F.explode("nodes").alias("node_id"))
    held = elements.select("elem_id", F.explode("nodes").alias("node_id"))
    full = wanted.join(held, "node_id").groupBy("face_id", "elem_id", "n").agg(F.count("*").alias("met")).where("met = n")
    return full.groupBy("face_id").agg(F.min("elem_id").alias("elem_id"))


def smooth(nodes: DataFrame, edges: DataFrame, factor: float) -> DataFrame:
    """One step of smoothing: each node moves by the factor towards the mean of its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    mean = both.join(nodes, both.b == nodes.node_id).groupBy("a").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    return nodes.join(mean, nodes.node_id == mean.a, "left").select("node_id", *(F.expr(f"{c} + {factor}D * (coalesce(m{c}, {c}) - {c})").alias(c) for c in "xyz"))
