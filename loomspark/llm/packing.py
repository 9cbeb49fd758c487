"""Packing by vector bins: the dot-product heuristic.

An example has a vector of demands - tokens, one segment, loss-bearing tokens - and a sequence has a
limit for each. A sequence is filled by placing, again and again, the example that fits and whose
demands have the largest dot product with what is left of the limits, each taken as a share of its
limit; so that dimension is used up first which is plentiful. Examples with equal vectors
are one class with a count, so a placement costs one product with the distinct vectors.

Work is done in blocks within a task: no shuffle, and the memory is that of a block. Ids of sequences
are the partition's number and a counter, unique over the table and the same when a task is run again.

Where examples may be cut (documents), whole sequences are cut off first, and the gap that no piece fits
is filled with the front of a longer one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import documents

TOKENIZER = "byte_bpe_50k.json"
#: Splits as ``public_tokenizers.PATTERN`` does; runs are possessive and words come first, which costs less.
SPLIT = r" ?\p{L}++|'(?:[sdmt]|ll|ve|re)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SEPARATOR = 0


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024


#: Pieces, or examples, that are packed together.
BLOCK = 8192


class DotProductPacker:
    """Places classes of equal vectors; ``place`` gives for each sequence its [class, ...] in order."""

    def __init__(self, vectors: np.ndarray, counts: np.ndarray, limits: Limits):
        self.limits = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        if (vectors > self.limits).any() or (vectors < 0).any():
            raise ValueError("an example doesn't fit an empty sequence")
        self.vectors, self.shares, self.counts = vectors.astype(float), vectors / self.limits, counts.copy()

    def best(self, room: np.ndarray) -> int:
        """The class to place next, or -1 if none fits."""
        fits = (self.counts > 0) & (self.vectors <= room).all(1)
        if not fits.any():
            return -1
        value = np.where(fits, self.shares @ (room / self.limits), -1.0)
        return int(value.argmax())

    def place(self) -> Iterator[list[int]]:
        while self.counts.any():
            room, row = self.limits.copy(), []
            while (k := self.best(room)) >= 0:
                self.counts[k] -= 1
                room -= self.vectors[k]
                row.append(k)
            yield row


class IdReader:
    """The ids of ``tokenizers`` over its own file.

    Text in Latin letters takes a shorter way: the file's vocabulary in a rank encoder, which gives the same
    ids, as the file's merges are in the order of its ids and both split by one pattern (tests compare them).
    Other text goes through ``tokenizers`` itself, as the tables of two Unicode versions may differ; so does text
    that quotes an added token, which has that token's id.
    """

    def __init__(self, path: str | None = None):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path(TOKENIZER)
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        back = {c: b for b, c in _byte_letters().items()}
        added = self.whole.get_added_tokens_decoder()
        self.largest = max(*model["vocab"].values(), *added)
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if i not in added}
        self.fast = tiktoken.Encoding("vocab", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.other = re.compile("|".join(["[^\t-\r\x20-\x7e\xa1-ɏ]", *(re.escape(token.content) for token in added.values())]))

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(array("I", self._ids(text)), np.uint32)

    def separated(self, text: str) -> np.ndarray:
        """The ids with the separator behind them."""
        ids = array("I", self._ids(text))
        ids.append(SEPARATOR)
        return np.frombuffer(ids, np.uint32)

    def count(self, text: str) -> int:
        return len(self._ids(text))

    def _ids(self, text: str) -> list[int]:
        if self.other.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=4)
def id_reader(path: str | None = None) -> IdReader:
    """One for each worker process: its tasks share it."""
    return IdReader(path)


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it is printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def pack_examples(df: DataFrame, example_id: str, tokens: str, loss_tokens: str, limits: Limits = Limits(), block: int = BLOCK) -> DataFrame:
    """(example_id, sequence_id, position, offset): whole examples, placed under all limits.

    Null counts are 0. An example beyond a limit is an error, as it can't be placed whole.
    """
    picked = df.select(F.col(example_id).alias("example_id"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("t"), F.coalesce(F.col(loss_tokens), F.lit(0)).cast("long").alias("l"))
    kind = dict(picked.dtypes)["example_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids = part.column(0).to_pylist()
                vectors = np.stack([part.column(1).to_numpy(zero_copy_only=False), np.ones(len(ids), np.int64), part.column(2).to_numpy(zero_copy_only=False)], 1)
                kinds, inverse, counts = np.unique(vectors, axis=0, return_inverse=True, return_counts=True)
                waiting: list[list[int]] = [[] for _ in kinds]
                for i in range(len(ids) - 1, -1, -1):
                    waiting[inverse[i]].append(i)
                rows = []
                for row in DotProductPacker(kinds, counts, limits).place():
                    offset = 0
                    for position, k in enumerate(row):
                        rows.append((ids[waiting[k].pop()], base + number, position, offset))
                        offset += int(kinds[k, 0])
                    number += 1
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], part.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], names=["example_id", "sequence_id", "position", "offset"])

    return picked.mapInArrow(run, f"example_id {kind}, sequence_id long, position int, offset long")


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Block:
    """Pieces shorter than a sequence, by length: (doc_id, start, ids, doc_tokens)."""

    def __init__(self, limits: Limits):
        self.limits, self.by, self.n = limits, {}, 0

    def add(self, piece) -> None:
        self.by.setdefault(len(piece[2]), []).append(piece)
        self.n += 1

    def sequences(self) -> Iterator[list]:
        """All pieces in sequences. The token is the loss-bearing one, so both demands are equal."""
        top = self.limits.tokens
        sizes = np.arange(1, top)
        vectors = np.stack([sizes, np.ones_like(sizes), sizes], 1)
        packer = DotProductPacker(vectors, np.array([len(self.by.get(s, ())) for s in sizes]), self.limits)
        while packer.counts.any():
            room, row = packer.limits.copy(), []
            while room[0] and room[1] and room[2]:
                k = packer.best(room)
                if k >= 0:
                    packer.counts[k] -= 1
                    piece = self.by[k + 1].pop()
                else:
                    # the gap: the front of the longest piece that waits, if any does
                    left = np.flatnonzero(packer.counts)
                    if not len(left):
                        break
                    k, gap = int(left[-1]), int(min(room[0], room[2]))
                    packer.counts[k] -= 1
                    doc_id, start, ids, total = self.by[k + 1].pop()
                    piece, rest = (doc_id, start, ids[:gap], total), (doc_id, start + gap, ids[gap:], total)
                    self.by.setdefault(len(rest[2]), []).append(rest)
                    packer.counts[len(rest[2]) - 1] += 1
                row.append(piece)
                room -= (len(piece[2]), 1, len(piece[2]))
            yield row


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits(), path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Every id of every document, with the separator behind it, in one piece of one sequence.

    A null or empty text is the separator alone. Repeated rows are packed each for itself. Sequences
    are full but for the last of a block of ``block`` pieces.
    """
    if limits.loss_tokens < limits.tokens:
        raise ValueError("every token of a document bears loss, so its limit can't be under that of tokens")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = id_reader(path)
        base, number, top = TaskContext.get().partitionId() << 33, 0, limits.tokens
        rows: list[tuple] = []
        waiting = _Block(limits)

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in _SCHEMA.split(", ")])

        def emit(row) -> None:
            nonlocal number
            offset = 0
            for i, start, ids, total in row:
                rows.append((i, start, len(ids), zlib.crc32(ids), total, base + number, offset))
                offset += len(ids)
            number += 1

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = read.separated(value or "")
                    for start in range(0, len(ids), top):
                        piece = (i, start, ids[start : start + top], len(ids))
                        if len(piece[2]) == top:
                            emit([piece])
                        else:
                            waiting.add((i, start, piece[2].copy(), len(ids)))
                if waiting.n >= block:
                    for row in waiting.sequences():
                        emit(row)
                    waiting = _Block(limits)
                if len(rows) >= 4096:
                    yield out()
        for row in waiting.sequences():
            emit(row)
        if rows:
            yield out()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
