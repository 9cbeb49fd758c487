"""Token ids in training order, as fixed-stride binary shards.

The ids of a task's documents, each with the separator behind it, are one stream that is cut into sequences of
``LENGTH`` ids. A keyed Feistel network over the smallest even number of bits, walked along its cycle until it
falls below the number of sequences, is a permutation of them; it gives each sequence its global slot. Slots are
dealt by ranges, ``SHARD`` to a file (more in tables beyond ``MOST_SHARDS`` files), and a file holds its sequences in order at a fixed stride: slot s
stands in file s // SHARD at byte (s % SHARD) * stride, so reading can resume anywhere.

Two passes: the first only counts, so that every partition knows the number of its first sequence; the second
makes the ids and fails if it counts differently. A file is written under another name and then
renamed, so a task that is run again, or twice, leaves one whole file.

Null and empty texts are the separator alone; the last sequence of a partition is filled with separators. An
empty table has no shards. Repeated rows are written each for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import documents, shared_dir
from loomspark.llm.packing import SEPARATOR, id_reader

LENGTH = 1024
#: Sequences to a file, at least; files beyond which they get larger; and tasks beyond which each writes several.
SHARD, MOST_SHARDS, MOST_TASKS = 4096, 1 << 16, 20_000
ROUNDS = 6
KEY = 0x5EED


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of 0 .. n - 1."""

    n: int
    key: int = KEY

    @property
    def half(self) -> int:
        return max(1, ((max(1, self.n - 1)).bit_length() + 1) // 2)

    def _round(self, x: np.ndarray, i: int) -> np.ndarray:
        # splitmix64 finalizer
        z = x + np.uint64((self.key * 0x9E3779B97F4A7C15 + (i + 1) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) & np.uint64((1 << self.half) - 1)

    def _step(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        mask, half = np.uint64((1 << self.half) - 1), np.uint64(self.half)
        left, right = x >> half, x & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(left, i), left
            else:
                left, right = right, left ^ self._round(right, i)
        return (left << half) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        x = np.atleast_1d(np.asarray(x, np.uint64))
        if (x >= self.n).any():
            raise ValueError("a number is outside the domain")
        x = self._step(x, back)
        while (out := x >= self.n).any():
            x[out] = self._step(x[out], back)
        return x

    def slot(self, index) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot) -> np.ndarray:
        return self._walk(slot, True)


def _stream(batches: Iterable[pa.RecordBatch], length: int, path: str | None, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(first document, its ids before the sequence, ids) of each sequence of a task."""
    read = id_reader(path)
    if read.largest >> (8 * width):
        raise ValueError(f"ids don't fit {width} bytes")
    buffer = np.full(length, SEPARATOR, f"<u{width}")
    filled, first, begun = 0, None, 0
    for batch in batches:
        ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
        for at in range(0, len(ids_of), 256):
            for doc, value in zip(ids_of[at : at + 256], texts.slice(at, 256).to_pylist(), strict=True):
                ids = read.separated(value or "")
                start = 0
                while start < len(ids):
                    if not filled:
                        first, begun = doc, start
                    n = min(length - filled, len(ids) - start)
                    buffer[filled : filled + n] = ids[start : start + n]
                    filled, start = filled + n, start + n
                    if filled == length:
                        yield first, begun, buffer.tobytes()
                        filled = 0
    if filled:
        buffer[filled:] = SEPARATOR
        yield first, begun, buffer.tobytes()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def shard_size(total: int) -> int:
    """Sequences to a file for a table of so many, when none is asked for: a power of two."""
    return max(SHARD, 1 << (-(-total // MOST_SHARDS) - 1).bit_length()) if total else SHARD


def materialise(df: DataFrame, out: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, shard: int | None = None, key: int = KEY, path: str | None = None, width: int = 2) -> DataFrame:
    """Writes the shards below ``out``, a folder that all executors see, and returns a row for each sequence, of
    what was read back: slot, shard, byte_offset, first_doc_id, first_start, n_bytes, crc32.

    ``df`` must give its partitions alike each time, as a table's scan does; ``width`` is the bytes of an id.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def count(batches):
        read = id_reader(path)
        ids = sum(read.count(x or "") + 1 for batch in batches for at in range(0, batch.num_rows, 256) for x in batch.column(1).slice(at, 256).to_pylist())
        n = -(-ids // length)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["part", "n"])

    # a row for each partition of the input
    counts = {r["part"]: r["n"] for r in rows.mapInArrow(count, "part int, n long").collect()}
    firsts, total = {}, 0
    for part in sorted(counts):
        firsts[part] = total
        total += counts[part]
    order = Feistel(total, key)
    shard = shard or shard_size(total)
    places = df.sparkSession.sparkContext.broadcast((firsts, counts))

    def place(batches):
        part = TaskContext.get().partitionId()
        first, n = places.value[0][part], places.value[1][part]
        slots = order.slot(np.arange(first, first + n, dtype=np.uint64)).astype(np.int64) if n else []
        made, waiting = 0, []

        def out_batch():
            docs, starts, at, data = zip(*waiting, strict=True)
            waiting.clear()
            at = np.array(at)
            return pa.RecordBatch.from_arrays([pa.array(at // shard, pa.int32()), pa.array(at, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], names=["shard", "slot", "first_doc_id", "first_start", "ids"])

        for doc, start, ids in _stream(batches, length, path, width):
            if made == n:
                raise RuntimeError("the input gave other partitions the second time")
            waiting.append((doc, start, int(slots[made]), ids))
            made += 1
            if len(waiting) == 512:
                yield out_batch()
        if made != n:
            raise RuntimeError("the input gave other partitions the second time")
        if waiting:
            yield out_batch()

    def write(batches):
        import uuid

        from pyarrow import fs

        system, base = _filesystem(out)
        stride, current, file, temporary, rows_of = length * width, None, None, None, []

        def finish():
            file.close()
            name = f"{base}/shard-{current:06d}.bin"
            if system.get_file_info(name).type != fs.FileType.NotFound:
                # a task that ran before has left it; not every file system renames onto a file
                system.delete_file(name)
            system.move(temporary, name)
            with system.open_input_file(name) as back:
                crcs = []
                for slot, _, _ in rows_of:
                    back.seek((slot % shard) * stride)
                    crcs.append(zlib.crc32(back.read(stride)))
            slots, docs, starts = zip(*rows_of, strict=True)
            n = len(slots)
            offsets = [(s % shard) * stride for s in slots]
            return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([current] * n, pa.int32()), pa.array(offsets, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([stride] * n, pa.int32()), pa.array(crcs, pa.int64())], names=["slot", "shard", "byte_offset", "first_doc_id", "first_start", "n_bytes", "crc32"])

        for batch in batches:
            for number, slot, doc, start, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if number != current:
                    if current is not None:
                        yield finish()
                    current, rows_of = number, []
                    system.create_dir(base, recursive=True)
                    temporary = f"{base}/.shard-{number:06d}-{uuid.uuid4().hex}"
                    file = system.open_output_stream(temporary)
                if slot != number * shard + len(rows_of):
                    raise RuntimeError("a slot is missing or comes twice")
                file.write(ids)
                rows_of.append((slot, doc, start))
        if current is not None:
            yield finish()

    placed = rows.mapInArrow(place, "shard int, slot long, first_doc_id long, first_start long, ids binary")
    n_shards = max(1, -(-total // shard))
    # equal ranges of slots are known beforehand, so no sampling pass is needed: a task has one shard, or several in a large table
    per_task = -(-n_shards // MOST_TASKS)
    dealt = placed.repartitionById(-(-n_shards // per_task), F.expr(f"CAST(shard div {per_task} AS INT)")).sortWithinPartitions("shard", "slot")
    return dealt.mapInArrow(write, "slot long, shard int, byte_offset long, first_doc_id long, first_start long, n_bytes int, crc32 long")


def read_sequences(out: str, slots: range, length: int = LENGTH, shard: int = SHARD, width: int = 2) -> Iterator[np.ndarray]:
    """The sequences of a range of slots, in order, from the shards below ``out``."""
    system, base = _filesystem(out)
    stride, file, current = length * width, None, None
    for slot in slots:
        if slot // shard != current:
            current = slot // shard
            file = system.open_input_file(f"{base}/shard-{current:06d}.bin")
        file.seek((slot % shard) * stride)
        yield np.frombuffer(file.read(stride), f"<u{width}")


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(documents(spark, sf_dir), shared_dir(spark, "shards"))
