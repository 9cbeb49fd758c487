"""SimHash near-duplicates by multi-index hashing.

Fingerprints are computed in one pass over the texts. Copies share a fingerprint, so only
distinct fingerprints are linked: each is filed under its two 32-bit halves, and of two
fingerprints with at most three differing bits one half differs in at most one bit. So for each
half the ball of radius one (33 keys) is looked up, and every match is verified on all 64 bits.

Members of each half are linked to its least member first, so that a large group is one component before any pair
is met; balls are then looked up across components only.

Components come from alternating star contractions over the links; each round is written
to the checkpoint folder. Nothing is gathered on the driver but a count of changes.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import documents, ensure_checkpoint_dir, free_shuffles, map_rows

SEED = 42
SHINGLE = 3
MAX_BITS = 3
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: For groups of similar texts: words of a shingle, the Jaccard similarity of two sets that links them, the longs of a fingerprint, the
#: bits of a segment, and the longs of the marks: a byte of each table's anchor, half a byte of each of 112 further ones.
WIDE_WORDS, ALIKE, PRINTS, SEGMENT, BYTES, HALVES = 5, 0.8, ("f0", "f1", "f2", "f3"), 16, ("g0", "g1"), tuple(f"h{i}" for i in range(7))
SKETCH = (*PRINTS, *BYTES, *HALVES)
TABLES = 64 * len(PRINTS) // SEGMENT
ANCHORS = TABLES + 16 * len(HALVES)
#: Tables in which a text has an anchor in common with another one, at least, to be looked at.
LEAST_SHARED = 6
#: Bits of the fingerprints that differ and twice the marks that do, at most, in a candidate: at a similarity of 0.8
#: 87 are expected, give or take 11.
FAR = 112
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: What an anchor's order of the shingles is made with: a number to xor and an odd one to multiply.
_ORDERS = np.random.default_rng(42).integers(0, 1 << 64, (2, ANCHORS), np.uint64) | np.array([[0], [1]], np.uint64)
#: Where the numbers of so many shingles are made: memory that isn't asked for again and again.
_ROOM = np.empty((ANCHORS, 256), np.uint64)
#: Rows under one key from which its main component is kept from meeting itself.
HOT_KEY = 256
#: Hashes whose bits are counted at once.
BLOCK = 1 << 14


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_LOWER))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words joined by spaces, or of all words if there are fewer."""
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")


def _mixed(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th of several independent numbers of each hash; the hash itself for 0."""
    if not i:
        return hashes
    z = hashes ^ np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray, n: int = 1) -> list[int]:
    """``n`` fingerprints of 64 bits: a bit is 1 if it is in over half of the hashes."""
    out = []
    for k in range(n):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), BLOCK):
            part = np.ascontiguousarray(_mixed(hashes[at : at + BLOCK], k))
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))
    return out


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Zero if there is no word."""
    words = words_of(text)
    return majority(shingle_hashes(words, width))[0] if words else 0


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; null and empty texts have zero."""

    def make():
        def work(columns):
            values = [fingerprint(x, width) for x in columns[1]]
            return {"doc_id": columns[0], "fp": [v - (1 << 64) if v >> 63 else v for v in values]}

        return work

    return map_rows(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make, "doc_id long, fp long")


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct longs in ``fp`` with at most ``max_bits`` <= 3 differing bits."""
    return _ball_links(distinct.select("fp", F.col("fp").alias("root")), max_bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ball_links(placed: DataFrame, max_bits: int) -> DataFrame:
    """Pairs of fingerprints (fp, root) with different roots and at most ``max_bits`` differing bits, as they are found."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves and balls of radius one find up to three differing bits")
    # The half's number goes into bit 32, so that a key is one long.
    keys = F.expr("array(shiftrightunsigned(fp, 32), (fp & 4294967295L) + 4294967296L)")
    table = placed.select(F.col("root").alias("to"), F.col("fp").alias("y"), F.explode(keys).alias("key"))
    probes = placed.select(F.col("root").alias("from"), F.col("fp").alias("x"), F.explode(keys).alias("own"))
    probes = _round_balls(probes, 32)
    return across_roots(probes, table, F.bit_count(F.expr("x ^ y")) <= max_bits).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _round_balls(probes: DataFrame, width: int) -> DataFrame:
    """``own`` as every ``key`` to look up. Two keys that differ in one bit have different parities, so only even
    keys go round their ball and each pair is met once; equal keys meet without a flip."""
    even = f"bit_count(own & {(1 << width) - 1}L) % 2 = 0"
    flips = F.expr(f"CASE WHEN {even} THEN concat(array(0L), transform(sequence(0, {width - 1}), i -> shiftleft(1L, i))) ELSE array(0L) END")
    rest = [c for c in probes.columns if c != "own"]
    return probes.select("*", F.explode(flips).alias("flip")).select(*rest, F.expr("own ^ flip").alias("key"))


def across_roots(probes: DataFrame, table: DataFrame, near: Column) -> DataFrame:
    """Rows of ``probes`` (from, key, ...) and ``table`` (to, key, ...) that share a key, have different roots and are ``near``.

    In a hot key (over ``HOT_KEY`` rows of the table) most rows have one root, as its members were linked to
    their least one before. Probes of that root meet only the other rows there, so a component of any size
    isn't compared with itself: the work is the rows times those of other components. No pair across is lost.
    """
    sizes = table.groupBy("key", "to").agg(F.count("*").alias("n")).groupBy("key")
    hot = sizes.agg(F.sum("n").alias("rows"), F.max_by("to", F.struct("n", "to")).alias("main")).where(F.col("rows") > HOT_KEY).select("key", "main").checkpoint()
    apart = (F.col("from") != F.col("to")) & near
    plain = probes.join(hot, "key", "left_anti").join(table, "key").where(apart)
    mine = F.when(F.col("from") == F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    asked = probes.join(hot, "key").select(*probes.columns, F.explode(mine).alias("in_main"))
    filed = table.join(hot, "key").select(*table.columns, (F.col("to") == F.col("main")).alias("in_main"))
    split = asked.join(filed, ["key", "in_main"]).where(apart)
    return plain.unionByName(split.select(*plain.columns))


def _stars(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) of each half's members to the least member that has the same half, where near."""
    halves = F.expr("array(shiftrightunsigned(fp, 32), (fp & 4294967295L) + 4294967296L)")
    table = distinct.select("fp", F.explode(halves).alias("key"))
    least = table.groupBy("key").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1").select("key", "m")
    return table.join(least, "key").where("fp != m").where(F.bit_count(F.expr("fp ^ m")) <= max_bits).select(F.col("m").alias("a"), F.col("fp").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected edges (a, b).

    Alternates large-star and small-star (Kiveris et al., Connected Components in MapReduce and Beyond, 2014) until nothing changes; each
    costs a grouped minimum, partial first, and an equi-join. The join brings all neighbours of a node to its key: a node with very many is
    a skewed key, which adaptive execution splits.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct().checkpoint()
    before = _sum_of(edges)
    for _ in range(rounds):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionAll(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct().checkpoint()
        now = _sum_of(small)
        edges, before, settled = small, now, now == before
        del both, least, large, small
        free_shuffles(edges.sparkSession)
        if settled:
            break
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _sum_of(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart: their number and a sum over their hashes, which one pass gives."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of fingerprints.

    Null and empty texts have fingerprint zero and link like any other; repeated rows stay.
    """
    ensure_checkpoint_dir(df.sparkSession)
    prints = fingerprints(df, doc_id, text, width).checkpoint()
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint()
    stars = _stars(distinct.select("fp"), max_bits).checkpoint()
    root = components(stars)
    placed = distinct.join(root, distinct.fp == root.node, "left").select("fp", F.coalesce("root", "fp").alias("root")).checkpoint()
    found = components(stars.unionAll(_ball_links(placed, max_bits)))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")


def sketch(text: str | None) -> tuple[int, list[int], np.ndarray]:
    """What the distinct ``WIDE_WORDS``-word shingles give: a number of the set, its fingerprint of ``PRINTS`` longs, and ``ANCHORS``
    anchors, each the least shingle in an order of its own. The first ones belong to the fingerprint's segments."""
    hashes = set_of(text)
    prints = majority(hashes, len(PRINTS))
    least = np.full(ANCHORS, _LAST, np.uint64)
    for at in range(0, len(hashes), _ROOM.shape[1]):
        part = hashes[at : at + _ROOM.shape[1]]
        room = _ROOM[:, : len(part)]
        np.bitwise_xor(part, _ORDERS[0][:, None], out=room)
        np.multiply(room, _ORDERS[1][:, None], out=room)
        np.minimum(least, room.min(1), out=least)
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED), prints, least


def segments(prints: list[int]) -> list[int]:
    """The fingerprint's segments of ``SEGMENT`` bits, as the plan cuts them."""
    return [print_ >> at & (1 << SEGMENT) - 1 for print_ in prints for at in range(0, 64, SEGMENT)]


def set_of(text: str | None) -> np.ndarray:
    """The distinct ``WIDE_WORDS``-word shingles' hashes in order; none if there is no word."""
    words = words_of(text)
    return np.unique(shingle_hashes(words, WIDE_WORDS)) if words else np.empty(0, "<u8")


def marks(least: np.ndarray) -> np.ndarray:
    """The longs ``BYTES`` and ``HALVES`` of sketches' anchors."""
    low = least.astype(np.uint8)
    halves = (low[:, TABLES::2] & 15) | (low[:, TABLES + 1 :: 2] << 4)
    return np.ascontiguousarray(np.hstack([low[:, :TABLES], halves])).view("<i8")


def sketches(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (the same for repeated rows only), node (the same for equal sets of shingles), ``SKETCH`` and the tables' anchors."""

    def make():
        def work(columns):
            found = [sketch(value) for value in columns[1]]
            signed = lambda values: [v - (1 << 64) if v >> 63 else v for v in values]
            prints = {c: signed(f[1][i] for f in found) for i, c in enumerate(PRINTS)}
            least = np.array([f[2] for f in found]).reshape(-1, ANCHORS)
            marked = {c: x for c, x in zip(BYTES + HALVES, marks(least).T, strict=True)}
            anchors = np.ascontiguousarray(least[:, :TABLES]).view(np.int64).tolist()
            return {"doc_id": columns[0], "row": columns[2], "node": signed(f[0] for f in found), "anchors": anchors} | prints | marked

        return work

    schema = "doc_id long, row long, node long, anchors array<long>, " + ", ".join(f"{c} long" for c in SKETCH)
    return map_rows(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), _row(doc_id, text).alias("row")), make, schema)


def _row(doc_id: str, text: str) -> Column:
    """Tells rows apart whose ids are null, or equal over different texts. Nulls are skipped by the hash, hence the flags."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(text).isNull(), F.col(doc_id).cast("long"), F.col(text))


def _far(x: str, y: str) -> str:
    """The distance of two sketches: bits of the fingerprints that differ, and twice the marks that do."""
    bits = [f"bit_count({x}{c} ^ {y}{c})" for c in PRINTS]
    differ = []
    for names, width, lowest in ((BYTES, 8, 0x0101010101010101), (HALVES, 4, 0x1111111111111111)):
        any_bit = " | ".join(f"shiftrightunsigned({{0}}, {i})" if i else "{0}" for i in range(width))
        differ += [f"bit_count(({any_bit.format(f'({x}{c} ^ {y}{c})')}) & {lowest}L)" for c in names]
    return f"{' + '.join(bits)} + 2 * ({' + '.join(differ)})"


def _met_before(x: str, y: str) -> str:
    """Whether two sketches share a key in a table before ``table``, by their marks: a pair is taken where it meets first."""
    earlier = []
    for i in range(TABLES - 1):
        mark, segment = BYTES[i // 8], PRINTS[i * SEGMENT // 64]
        same = f"(shiftrightunsigned({x}{mark} ^ {y}{mark}, {i % 8 * 8}) & 255L) = 0"
        near = f"bit_count(shiftrightunsigned({x}{segment} ^ {y}{segment}, {i * SEGMENT % 64}) & {(1 << SEGMENT) - 1}L) <= 1"
        earlier.append(f"(table > {i} AND {same} AND {near})")
    return " OR ".join(earlier)


def filed(nodes: DataFrame) -> DataFrame:
    """The tables' rows (table, anchor, segment, node, sketch) whose anchor some other node has in the same table, and the node's weight.

    A text that has a similar one shares 13 of its 16 anchors, give or take 2; with fewer than ``LEAST_SHARED`` in common with
    anything (one such text in 100,000) it has none, and most haven't: only the rest is looked at further.
    The weight is how many rows share a node's anchors in all: of a group of edited copies the least edited one has the most.
    """
    per_long = 64 // SEGMENT
    segment = f"array({', '.join(f'CAST(shiftrightunsigned({c}, {SEGMENT * i}) & {(1 << SEGMENT) - 1} AS INT)' for c in PRINTS for i in range(per_long))})"
    keys = nodes.select("node", F.posexplode("anchors").alias("table", "anchor"))
    shared = keys.groupBy("table", "anchor").agg(F.count("*").alias("n")).where("n > 1")
    keys = keys.join(shared, ["table", "anchor"])
    weighed = keys.groupBy("node").agg(F.sum("n").alias("weight"), F.collect_list(F.struct("table", "anchor")).alias("at")).where(F.size("at") >= LEAST_SHARED).join(nodes.select("node", *SKETCH), "node")
    return weighed.select("node", "weight", *SKETCH, F.inline("at")).withColumn("segment", F.expr(f"{segment}[table]"))


def star_candidates(rows: DataFrame, far: int = FAR) -> DataFrame:
    """Pairs (a, b) of a node b and two of the leaders, the nodes of most weight under its keys (anchor and segment): the heaviest and the nearest one.

    A text that is alike to any of a group is so to its heaviest members as a rule, so one link joins it to the group.
    """
    leaders = rows.groupBy("table", "anchor", "segment").agg(F.max(F.struct("weight", "node", *SKETCH)).alias("y"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = rows.join(leaders, ["table", "anchor", "segment"]).where(f"node != y.node AND {_far('', 'y.')} <= {far}")
    best = met.groupBy("node").agg(F.max(F.struct("y.weight", "y.node")).alias("heaviest"), F.expr(f"min_by(y.node, {_far('', 'y.')})").alias("nearest"))
    return best.select(F.explode(F.array_distinct(F.array("heaviest.node", "nearest"))).alias("a"), F.col("node").alias("b"))


def candidates(placed: DataFrame, far: int = FAR) -> DataFrame:
    """Pairs (a, b) of nodes with different roots whose segments under a common anchor differ in one bit at most and whose sketches in
    ``far`` at most; ``placed`` has the tables' rows and each node's root."""
    several = placed.groupBy("table", "anchor").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("table", "anchor")
    rows = placed.join(several, ["table", "anchor"], "left_semi")
    key = lambda segment: F.xxhash64("table", "anchor", segment)
    renamed = lambda letter: [F.col(c).alias(f"{letter}{c}") for c in SKETCH]
    table = rows.select(F.col("root").alias("to"), F.col("node").alias("b"), *renamed("y"), key(F.col("segment").cast("long")).alias("key"))
    probes = rows.select("table", "anchor", F.col("root").alias("from"), F.col("node").alias("a"), *renamed("x"), F.col("segment").cast("long").alias("own"))
    probes = _round_balls(probes, SEGMENT).withColumn("key", key(F.col("key"))).drop("anchor")
    met = across_roots(probes, table, F.expr(f"{_far('x', 'y')} <= {far} AND NOT ({_met_before('x', 'y')})"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike(pairs: DataFrame, texts: DataFrame, least: float = ALIKE) -> DataFrame:
    """Of the pairs (a, b) those whose ``texts`` (node, text) have sets of shingles alike by ``least``."""
    asked = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    found = texts.join(asked, "node", "left_semi")
    rows = pairs.join(found.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def make():
        known: dict[int, np.ndarray] = {}

        def leader(node: int, text: str) -> np.ndarray:
            if node not in known:
                if len(known) == 64:
                    known.clear()
                known[node] = set_of(text)
            return known[node]

        def work(columns):
            keep = [i for i, (a, x, y) in enumerate(zip(columns[0], columns[2], columns[3], strict=True)) if similarity(leader(a, x), set_of(y)) >= least]
            return {"a": [columns[0][i] for i in keep], "b": [columns[1][i] for i in keep]}

        return work

    return map_rows(rows.select("a", "b", "x", "y"), make, "a long, b long")


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets; 0 if both are empty."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _rooted(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, row, root over texts whose sets of 5-word shingles are alike by 0.8 or more.

    Multi-index hashing finds candidates: a fingerprint of 256 bits has 16 segments of 16 bits, each with a table of its own, and balls of
    radius one are looked up there. At 0.8 some 15 % of the bits differ, so segments must be short, and short ones alone would
    meet by chance ever more often as the input grows. Hence a table's key is a segment with an *anchor*, a shingle that sets alike by
    J share with probability J, and sets with nothing in common never: chance meetings need a common passage and 15 of 16 equal bits.
    By reckoning 98 % of the pairs at exactly 0.8 meet, at any size of the input. Complete distances are verified, over the
    fingerprints and the marks of 128 anchors, and each link is then decided by the two sets themselves.

    Equal sets are one node. Each key's members are linked to its heaviest member first, so that a large group is one
    component before any pairs are made; balls are then looked up across components only. Thus a group of thousands gives
    no pairs, and no link between groups is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    spark = df.sparkSession

    def settled(rows: DataFrame) -> DataFrame:
        out = rows.checkpoint()
        del rows
        free_shuffles(spark)
        return out

    every = settled(sketches(df, doc_id, text))
    nodes = settled(every.dropDuplicates(["node"]))
    rows = settled(filed(nodes))
    suspects = nodes.join(rows.select("node").distinct(), "node", "left_semi").select("node", "row")
    texts = settled(df.select(_row(doc_id, text).alias("row"), F.col(text).alias("text")).join(suspects, "row").select("node", "text").dropDuplicates(["node"]))
    del suspects, nodes
    stars = settled(alike(settled(star_candidates(rows)), texts))
    root = components(stars).withColumnRenamed("node", "_node")
    placed = settled(rows.join(root, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node"))
    del rows, root
    pairs = settled(candidates(placed))
    del placed
    linked = settled(alike(pairs, texts))
    del pairs, texts
    root = components(stars.unionAll(linked)).withColumnRenamed("node", "_node")
    return every.join(root, F.col("node") == F.col("_node"), "left").select("doc_id", "row", F.coalesce("root", "node").alias("root"))


def similar_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id, the smallest id of the texts linked at a similarity of 0.8; null where all of them have none.

    Texts are linked, not ids: rows with equal ids and different texts are apart, and so are those without an id.
    """
    rooted = _rooted(df, doc_id, text).checkpoint()
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(ids, "root").select("doc_id", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of similar texts the row whose id is the smallest; one without an id only if none has any.

    Texts without a word are one group. Of repeated rows, and of similar texts under that one id, one stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = _rooted(df, doc_id, text).groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("_row")).checkpoint()
    free_shuffles(df.sparkSession)
    return df.withColumn("_row", _row(doc_id, text)).join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*df.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
