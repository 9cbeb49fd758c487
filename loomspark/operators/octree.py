"""Octrees as tables: a cell is (level, ix, iy, iz), its place counted in cells of its own level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import ensure_checkpoint_dir

_AT = ["ix", "iy", "iz"]
#: All places round a cell that share a face, an edge or a corner, and the cell's own.
_AROUND = "flatten(transform(sequence(-1, 1), a -> flatten(transform(sequence(-1, 1), b -> transform(sequence(-1, 1), c -> named_struct('ix', ix + a, 'iy', iy + b, 'iz', iz + c))))))"
_CHILDREN = "transform(sequence(0, 7), k -> named_struct('ix', ix * 2 + k % 2, 'iy', iy * 2 + k div 2 % 2, 'iz', iz * 2 + k div 4))"


def balance(leaves: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The coarsest leaves that refine ``leaves`` so that cells that touch differ by one level at most.

    ``shape`` is the number of cells of level 0 each way. Where a cell is split, the cells of its size around it must
    be there, so what they are part of is split too. That goes from the finest level up, once each: one distinct for
    each level, no loop until nothing changes. An empty table stays empty.
    """
    ensure_checkpoint_dir(leaves.sparkSession)
    leaves = leaves.select("level", *_AT)
    top = leaves.agg(F.max("level")).first()[0]
    if not top:
        return leaves.distinct()
    parents = leaves.where("level > 0").select("level", *_AT)
    parts: list[DataFrame] = []
    forced = None
    for level in range(top - 1, -1, -1):
        # Cells of this level that are split: ancestors of finer leaves, and those that a finer split needs.
        scale = f"CAST(pow(2, level - {level}) AS BIGINT)"
        above = parents.where(f"level > {level}").selectExpr(*(f"{c} div {scale} AS {c}" for c in _AT))
        split = (above if forced is None else above.unionByName(forced)).distinct().checkpoint()
        parts.append(split.select(F.lit(level).alias("level"), *_AT))
        inside = " AND ".join(f"n.{c} BETWEEN 0 AND {(n << level) - 1}" for c, n in zip(_AT, shape, strict=True))
        around = split.select(F.explode(F.expr(_AROUND)).alias("n")).where(inside)
        forced = around.selectExpr(*(f"n.{c} div 2 AS {c}" for c in _AT)).distinct()
    inner = reduce(DataFrame.unionByName, parts)
    made = inner.select((F.col("level") + 1).alias("level"), F.explode(F.expr(_CHILDREN)).alias("n")).select("level", "n.*")
    roots = leaves.where("level = 0").unionByName(inner.where("level = 0").select("level", *_AT))
    return roots.unionByName(made).distinct().join(inner, ["level", *_AT], "left_anti")
