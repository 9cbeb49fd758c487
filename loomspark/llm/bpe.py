"""Byte-level BPE by a monoid tree reduction.

A text is cut in halves until they are short; a leaf is encoded directly and two neighbours
are joined by encoding a window round their seam again. The window grows until both of its
edges are *stable cuts*: places where a non-space meets white space. No match of the split
pattern spans such a place (white space stands only at the head of a match or in a match of
white space alone), and the pattern looks neither behind nor, from a non-space, past the white
space, so the matches outside the window are those of the whole text; as merges never cross a
match, their ids are too. A side without a stable cut is taken whole, which is always right.

Nulls and empty texts give no ids; a text of any length is one row and is never cut short.
"""

from __future__ import annotations

import base64
import hashlib
import re

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import documents, map_rows

RANKS = "byte_bpe_50k.tiktoken"
#: Texts up to this many characters are leaves.
LEAF_CHARS = 4096
#: Ids up to this many are decoded at once.
LEAF_IDS = 4096

_STABLE = re.compile(r"\S(?=[ \n\t])")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TreeCodec:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str | None = None, pattern: str = public_tokenizers.PATTERN, leaf_chars: int = LEAF_CHARS):
        ranks = load_ranks(path or public_tokenizers.path(RANKS))
        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf_chars = max(2, leaf_chars)
        self.sizes = [0] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self.base.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product: both sides are encodings of ``text[lo:mid]`` and ``text[mid:hi]``."""
        start, reach = lo, 32
        while reach < 2 * (mid - lo):
            begin = max(lo, mid - reach)
            found = [m.end() for m in _STABLE.finditer(text, begin, mid)]
            if found:
                start = found[-1]
                break
            reach *= 2
        stop, reach = hi, 32
        while reach < 2 * (hi - mid):
            found = _STABLE.search(text, mid, min(hi, mid + reach))
            if found:
                stop = found.end()
                break
            reach *= 2
        keep = len(left) - self._count(reversed(left), len(text[start:mid].encode()))
        drop = self._count(right, len(text[mid:stop].encode()))
        return left[:keep] + self.base.encode_ordinary(text[start:stop]) + right[drop:]

    def _count(self, ids, n_bytes: int) -> int:
        """How many of the ids make up so many bytes; a stable cut is a token's edge."""
        n = 0
        for token in ids:
            if n_bytes <= 0:
                break
            n_bytes -= self.sizes[token]
            n += 1
        assert n_bytes == 0, "a window's edge isn't an edge of a token"
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self.base.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``out``, the ids of ``text``, as an array. A column of that name is replaced."""
    codec_path = path

    @F.pandas_udf("array<int>")
    def ids(texts):
        codec = _codec(codec_path)
        return texts.map(codec.encode)

    return df.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds ``out``, the bytes that the array ``ids`` stands for; null gives no bytes."""
    codec_path = path

    @F.pandas_udf("binary")
    def data(column):
        codec = _codec(codec_path)
        return column.map(lambda x: codec.decode([int(i) for i in x]) if x is not None else b"")

    return df.withColumn(out, data(F.col(ids)))


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encodes and decodes each text in one pass and keeps what identifies both results, so that
    ids needn't travel back and forth. Repeated rows give repeated rows."""

    def make():
        codec = _codec(path)

        def work(columns):
            out = {"doc_id": columns[0], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "round_trip": []}
            for value in columns[1]:
                ids = codec.encode(value)
                decoded = codec.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join([_TEXT[i] for i in ids] if len(_TEXT) >= len(codec.sizes) else map(str, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                out["round_trip"].append(decoded == (value or "").encode())
            return out

        return work

    picked = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(picked, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


_TEXT: list[str] = []
_CODECS: dict[str | None, TreeCodec] = {}


def _codec(path: str | None) -> TreeCodec:
    """One for each worker process."""
    if path not in _CODECS:
        _CODECS[path] = TreeCodec(path)
        _TEXT.extend(map(str, range(len(_TEXT), len(_CODECS[path].sizes))))
    return _CODECS[path]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
