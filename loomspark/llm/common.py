"""What the operators of this package share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows whose ``crc32(doc_id as text) mod 4`` is this are never learned from.
HELD_OUT = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """False for a null id, which is learned from like any other row."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder the cluster names in ``spark.checkpoint.dir``. Where none is named, a local session (tests) gets one of its
    own; on a cluster that is an error, as executors wouldn't see it."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomspark-"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, which all executors see."""
    import uuid

    ensure_checkpoint_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, folder: str) -> None:
    """Removes a folder that ``shared_dir`` gave, once nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files that only finished steps have read: its cleaner does so when the driver's garbage is
    collected, which it might not be for long."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def running(steps: str) -> str:
    """SQL of the sums of the numbers before each one of the array ``steps``.

    A fold that appends copies what it has; so blocks of 256 are folded, and then the blocks: the work stays about linear.
    """
    none, blocks = "CAST(array() AS array<bigint>)", "CAST(array() AS array<array<bigint>>)"
    block = f"aggregate(slice({steps}, c * 256 + 1, 256), named_struct('at', a.at, 'out', {none}), (b, x) -> named_struct('at', b.at + x, 'out', concat(b.out, array(b.at))))"
    return f"""CASE WHEN size({steps}) > 0 THEN flatten(aggregate(
        sequence(0, (size({steps}) - 1) div 256), named_struct('at', 0L, 'out', {blocks}),
        (a, c) -> aggregate(array({block}), a, (z, r) -> named_struct('at', r.at, 'out', concat(z.out, array(r.out)))),
        a -> a.out)) ELSE {none} END"""


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[list[list]], dict[str, list]]],
    schema: str,
    block_rows: int = 512,
) -> DataFrame:
    """Arrow-batched map: ``make()`` builds, once for each task, a function from the columns of
    a block of rows to the columns of the result. Blocks bound a worker's memory."""
    names = list(df.columns)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                out = work([part.column(i).to_pylist() for i in range(len(names))])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], text: str = "text", block_rows: int = 512) -> DataFrame:
    """The rows of ``df``, unchanged, for whose texts the function that ``make`` builds is true."""
    at = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = make()
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                yield part.filter(pa.array(accept(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
