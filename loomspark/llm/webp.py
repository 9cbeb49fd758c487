"""Lossless WebP: a decoder of the whole VP8L format, and media columns that are stored in it.

The decoder reads prefix codes, back-references and the colour cache, groups of codes chosen by an
entropy image, and inverts the predictor, cross-colour, subtract-green and palette
transforms; its result is an array of pixels (height, width, 4) in the order alpha, red, green, blue.

Prefix codes are read by array operations where an image has one group and no cache: at every bit the token that would begin
there and the place behind it are looked up, and what is left to do one by one is to walk from place to place.

A null text is stored as an empty one: 64 zero bytes. A byte is a grey pixel, so a text goes through a palette; in texts beyond
``MAX_GREY`` bytes four bytes are one pixel. Zeros after the payload fill the last row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import documents, map_rows

MAX_SIDE = 16384
#: Bytes of an image's row, and the multiple to which payloads are padded.
ROW = 64

# Fixed values of the format
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (280, 256, 256, 256, 40)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

#: Neighbours that short distance codes stand for: above or to the left, by Euclidean distance, then by |dx|, right first.
NEIGHBOURS = sorted(((dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

#: Widths of grey images double up to this one; the widest images hold four bytes a pixel.
WIDEST_GREY = MAX_SIDE // 2
MAX_GREY = WIDEST_GREY * MAX_SIDE
#: Bits whose tokens are looked up at once, and the bits behind them that these may reach into.
WINDOW, REACH = 1 << 18, 256
#: Images up to this many pixels are read one by one, which costs less.
FEW_PIXELS = 600


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:last], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)


#: Longest prefix code, and all numbers of so many bits with their bits reversed.
LONGEST_CODE = 15
_REVERSED = np.zeros(1 << LONGEST_CODE, np.uint32)
for _i in range(LONGEST_CODE):
    _REVERSED |= (np.arange(1 << LONGEST_CODE, dtype=np.uint32) >> np.uint32(_i) & np.uint32(1)) << np.uint32(LONGEST_CODE - 1 - _i)


def canonical(lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols in use, and each one's code with its bits in the order in which they are written."""
    sizes = np.asarray(lengths, np.int64)
    used = np.flatnonzero(sizes)
    used = used[np.argsort(sizes[used], kind="stable")]
    shares = 1 << (LONGEST_CODE - sizes[used])
    return used, _REVERSED[(np.cumsum(shares) - shares) & ((1 << LONGEST_CODE) - 1)]


class Prefix:
    """A canonical prefix code as a table over the next bits."""

    def __init__(self, lengths: Sequence[int]):
        sizes = np.asarray(lengths, np.int64)
        used, starts = canonical(lengths)
        self.lengths = lengths
        self.single = int(used[0]) if len(used) == 1 else None
        self.table: list[tuple[int, int]] | None = None
        if self.single is not None:
            self.width, self.symbols, self.sizes = 0, used.astype(np.int32), np.zeros(1, np.int32)
            return
        if not len(used) or int((1 << (LONGEST_CODE - sizes[used])).sum()) != 1 << LONGEST_CODE:
            raise ValueError("a prefix code isn't complete")
        self.width = int(sizes[used[-1]])
        # codes in order fill the numbers from 0 on, the first bit being the highest
        rows = np.repeat(np.arange(len(used)), 1 << (self.width - sizes[used]))
        rows = rows[_REVERSED[: 1 << self.width] >> np.uint32(LONGEST_CODE - self.width)]
        self.symbols, self.sizes = used.astype(np.int32)[rows], sizes[used].astype(np.int32)[rows]

    def at(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that begin with the bits of each word, and their lengths."""
        rows = words & np.uint32((1 << self.width) - 1)
        return self.symbols[rows], self.sizes[rows]

    def pairs(self) -> list[tuple[int, int]]:
        if self.table is None:
            self.table = list(zip(self.symbols.tolist(), self.sizes.tolist(), strict=True))
        return self.table

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        symbol, n = (self.table or self.pairs())[bits.peek(self.width)]
        bits.at += n
        return symbol


@lru_cache(maxsize=512)
def prefix_code(lengths: tuple[int, ...]) -> Prefix:
    """Codes are read only, and many images share theirs."""
    return Prefix(lengths)


@lru_cache(maxsize=4096)
def simple_code(size: int, first: int, second: int) -> Prefix:
    """One symbol without a bit, or two of one bit."""
    lengths = [0] * size
    lengths[first] = lengths[second] = 1
    return prefix_code(tuple(lengths))


def _read_code(bits: Bits, size: int) -> Prefix:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        return simple_code(size, first, bits.read(8) if two else first)
    lengths = [0] * size
    of_lengths = [0] * len(LENGTH_ORDER)
    n = 4 + bits.read(4)
    sizes = bits.read(3 * n)
    for i in range(n):
        of_lengths[LENGTH_ORDER[i]] = sizes >> 3 * i & 7
    code = prefix_code(tuple(of_lengths))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    if code.single is not None and code.single < 16:
        at = min(left, size)
        lengths[:at] = [code.single] * at
        left = 0
    table, mask, data, place = code.pairs(), (1 << code.width) - 1, bits.data, bits.at
    while at < size and left:
        left -= 1
        word = int.from_bytes(data[place >> 3 : (place >> 3) + 4], "little") >> (place & 7)
        symbol, n = table[word & mask]
        place += n
        if symbol < 16:
            lengths[at] = symbol
            last = symbol or last
            at += 1
            continue
        extra, least = ((2, 3), (3, 3), (7, 11))[symbol - 16]
        times = least + (word >> n & ((1 << extra) - 1))
        place += extra
        if at + times > size:
            raise ValueError("a run of code lengths is too long")
        if symbol == 16:
            lengths[at : at + times] = [last] * times
        at += times
    bits.at = place
    return prefix_code(tuple(lengths))


def _extended(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """Pixels of an entropy-coded image as 32-bit numbers, in rows."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise ValueError("the colour cache has no valid size")
    block, groups_of, n_groups, across = 0, None, 1, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        choice = _read_image(bits, across, -(-height >> block))
        groups_of = ((choice >> 8) & 0xFFFF).tolist()
        n_groups = max(groups_of) + 1
    groups = [[_read_code(bits, n + (1 << cache_bits if cache_bits and not k else 0)) for k, n in enumerate(ALPHABETS)] for _ in range(n_groups)]
    total = width * height
    if n_groups == 1 and not cache_bits and groups[0][0].single is None and total > FEW_PIXELS:
        return _read_tokens(bits, groups[0], width, total)
    pixels = [0] * total
    cache = [0] * (1 << cache_bits if cache_bits else 0)
    shift = 32 - cache_bits
    at = filed = 0
    group = groups[0]
    while at < total:
        if groups_of is not None:
            group = groups[groups_of[(at // width >> block) * across + (at % width >> block)]]
        green = group[0].read(bits)
        if green < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            pixels[at] = alpha << 24 | red << 16 | green << 8 | blue
            at += 1
        elif green < 280:
            length = _extended(bits, green - 256)
            distance = _distance(_extended(bits, group[4].read(bits)), width)
            if distance > at or at + length > total:
                raise ValueError("a reference leaves the image")
            for i in range(at, at + length):
                pixels[i] = pixels[i - distance]
            at += length
        else:
            if green - 280 >= len(cache):
                raise ValueError("a colour isn't in the cache")
            for i in range(filed, at):
                cache[(pixels[i] * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = pixels[i]
            filed = at
            pixels[at] = cache[green - 280]
            at += 1
    return np.array(pixels, np.uint32)


def _extra(symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of lengths or distances by their symbols and the bits behind, and how many bits these are."""
    extra = np.maximum(0, (symbols - 2) >> 1)
    values = ((2 + (symbols & 1)) << extra) + (words & ((np.uint32(1) << extra.astype(np.uint32)) - np.uint32(1))).astype(np.int64) + 1
    return np.where(symbols < 4, symbols + 1, values), extra


def _read_tokens(bits: Bits, group: list[Prefix], width: int, total: int) -> np.ndarray:
    """An image of one group of codes without a cache; the first code has several symbols, so each token has a bit."""
    end = 8 * len(bits.data)
    pixels = np.zeros(total, np.uint32)
    plain = all(c.single is not None for c in group[1:4])
    ground = np.uint32(group[3].single << 24 | group[1].single << 16 | group[2].single) if plain else np.uint32(0)
    literal = int(group[0].symbols.max()) < 256
    at = 0
    while at < total:
        first = bits.at >> 3
        n = min(WINDOW, end - bits.at)
        if n <= 0:
            raise ValueError("the stream ends early")
        raw = np.zeros((n + REACH) // 8 + 8, np.uint8)
        part = np.frombuffer(bits.data, np.uint8, min(len(raw), len(bits.data) - first), first)
        raw[: len(part)] = part
        words = np.ndarray(len(raw) - 4, "<u4", raw.data, strides=(1,))
        words = (words[:, None] >> np.arange(8, dtype=np.uint32)).ravel()[bits.at & 7 :]
        here = np.arange(n)
        symbols, sizes = group[0].at(words[:n])
        behind = here + sizes
        if not plain:
            red, size = group[1].at(words[behind])
            blue, more = group[2].at(words[behind + size])
            alpha, last = group[3].at(words[behind + size + more])
            colours = alpha.astype(np.uint32) << 24 | red.astype(np.uint32) << 16 | symbols.astype(np.uint32) << 8 | blue.astype(np.uint32)
            behind = np.where(symbols < 256, behind + size + more + last, behind)
        far = np.flatnonzero(symbols >= 256) if not literal else ()
        if len(far):
            place = far + sizes[far]
            lengths, more = _extra(symbols[far] - 256, words[place])
            place = place + more
            codes, size = group[4].at(words[place])
            place = place + size
            distances, more = _extra(codes, words[place])
            behind[far] = place + more
        steps = np.empty(n + 1, np.int64)
        np.minimum(behind, n, out=steps[:n])
        steps[n] = n
        taken = _walk(steps)
        if literal:
            taken = taken[: total - at]
            found = symbols[taken].astype(np.uint32)
            pixels[at : at + len(taken)] = (ground | found << np.uint32(8)) if plain else colours[taken]
            at += len(taken)
            bits.at += int(behind[taken[-1]])
            if bits.at > end:
                raise ValueError("the stream ends early")
            continue
        kinds = symbols[taken]
        if (kinds < 256).all():
            counts = np.ones(len(taken), np.int64)
        else:
            row = np.searchsorted(far, taken[kinds >= 256])
            counts = np.ones(len(taken), np.int64)
            counts[kinds >= 256] = lengths[row]
        starts = at + np.cumsum(counts) - counts
        enough = int(np.searchsorted(starts, total))
        taken, kinds, starts, counts = taken[:enough], kinds[:enough], starts[:enough], counts[:enough]
        single = kinds < 256
        pixels[starts[single]] = (ground | kinds[single].astype(np.uint32) << 8) if plain else colours[taken[single]]
        if not single.all():
            for start, length, code in zip(starts[~single].tolist(), counts[~single].tolist(), distances[np.searchsorted(far, taken[~single])].tolist(), strict=True):
                distance = _distance(code, width)
                if distance > start or start + length > total:
                    raise ValueError("a reference leaves the image")
                source = pixels[start - distance : min(start, start - distance + length)]
                pixels[start : start + length] = source if len(source) == length else np.resize(source, length)
        at = int(starts[-1] + counts[-1])
        bits.at += int(behind[taken[-1]])
        if bits.at > end:
            raise ValueError("the stream ends early")
    return pixels


def _walk(steps: np.ndarray) -> np.ndarray:
    """The places reached from 0 by going from each to ``steps`` of it, before the last one, where the walk ends.

    Steps of 2, 4, 8 and 16 are made by array operations; what goes one by one are the steps of 16.
    """
    doubled = [steps]
    for _ in range(4):
        doubled.append(doubled[-1][doubled[-1]])
    far, end, places, p = memoryview(doubled[4]), len(steps) - 1, [], 0
    while p < end:
        places.append(p)
        p = far[p]
    reached = np.array(places, steps.dtype)[:, None]
    for step in reversed(doubled[:4]):
        reached = np.stack([reached, step[reached]], 2).reshape(len(reached), -1)
    reached = reached.ravel()
    return reached[reached < end]


def _distance(code: int, width: int) -> int:
    if code > len(NEIGHBOURS):
        return code - len(NEIGHBOURS)
    dx, dy = NEIGHBOURS[code - 1]
    return max(1, dx + dy * width)


def _split(pixels: np.ndarray) -> np.ndarray:
    """(n, 4): alpha, red, green, blue."""
    return np.ascontiguousarray(pixels, ">u4").view(np.uint8).reshape(-1, 4)


def _undo_predictor(residual: np.ndarray, width: int, height: int, size_bits: int, modes: np.ndarray) -> np.ndarray:
    across = -(-width >> size_bits)
    modes = ((modes >> 8) & 15).tolist()
    out = [list(map(int, p)) for p in _split(residual)]
    average = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x

    def select(left, top, corner):
        p_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        p_top = sum(abs(p - c) for p, c in zip(left, corner, strict=True))
        return left if p_left < p_top else top

    def half(a, b):
        return [clamp(x + int((x - y) / 2)) for x, y in zip(a, b, strict=True)]

    black = [255, 0, 0, 0]
    for i in range(width * height):
        y, x = divmod(i, width)
        if not i:
            guess = black
        elif not y:
            guess = out[i - 1]
        elif not x:
            guess = out[i - width]
        else:
            left, top, right, corner = out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1]
            mode = modes[(y >> size_bits) * across + (x >> size_bits)]
            if mode == 0:
                guess = black
            elif mode <= 4:
                guess = (left, top, right, corner)[mode - 1]
            elif mode == 5:
                guess = average(average(left, right), top)
            elif mode <= 9:
                guess = average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
            elif mode == 10:
                guess = average(average(left, corner), average(top, right))
            elif mode == 11:
                guess = select(left, top, corner)
            elif mode == 12:
                guess = [clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
            elif mode == 13:
                guess = half(average(left, top), corner)
            else:
                guess = black
        out[i] = [(r + g) & 255 for r, g in zip(out[i], guess, strict=True)]
    return _join(np.array(out, np.uint8).reshape(-1, 4))


def _join(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts, np.uint8).view(">u4").ravel().astype(np.uint32)


def _blocks(width: int, height: int, size_bits: int) -> np.ndarray:
    """For each pixel, the index of its block."""
    across = -(-width >> size_bits)
    return ((np.arange(height) >> size_bits)[:, None] * across + (np.arange(width) >> size_bits)[None, :]).ravel()


def _undo_cross_colour(pixels: np.ndarray, width: int, height: int, size_bits: int, elements: np.ndarray) -> np.ndarray:
    parts = _split(pixels).copy()
    per = _split(elements)[_blocks(width, height, size_bits)].view(np.int8).astype(np.int32)
    delta = lambda factor, colour: (factor * colour.view(np.int8).astype(np.int32)) >> 5
    green = np.ascontiguousarray(parts[:, 2])
    red = ((parts[:, 1].astype(np.int32) + delta(per[:, 3], green)) & 255).astype(np.uint8)
    blue = parts[:, 3].astype(np.int32) + delta(per[:, 2], green) + delta(per[:, 1], red)
    parts[:, 1], parts[:, 3] = red, (blue & 255).astype(np.uint8)
    return _join(parts)


def _undo_palette(pixels: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    bundle = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    index = (pixels >> 8) & 255
    if bundle:
        n = 8 >> bundle
        index = ((index[:, None] >> (np.arange(1 << bundle) * n)[None, :].astype(np.uint32)) & ((1 << n) - 1)).reshape(height, -1)[:, :width].ravel()
    colours = np.zeros(256, np.uint32)
    colours[: len(table)] = table
    return colours[index]


def decode_vp8l(data: bytes) -> np.ndarray:
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("this is no lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("the version isn't known")
    transforms, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            transforms.append((kind, across, size_bits, _read_image(bits, -(-across >> size_bits), -(-height >> size_bits))))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, across, 0, None))
        else:
            n = bits.read(8) + 1
            steps = _split(_read_image(bits, n, 1))
            transforms.append((kind, across, 0, _join((np.cumsum(steps, 0) & 255).astype(np.uint8))))
            across = -(-across >> (3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0))
    pixels = _read_image(bits, across, height, main=True)
    for kind, wide, size_bits, extra in reversed(transforms):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, wide, height, size_bits, extra)
        elif kind == CROSS_COLOUR:
            pixels = _undo_cross_colour(pixels, wide, height, size_bits, extra)
        elif kind == SUBTRACT_GREEN:
            parts = _split(pixels).copy()
            parts[:, 1] += parts[:, 2]
            parts[:, 3] += parts[:, 2]
            pixels = _join(parts)
        else:
            pixels = _undo_palette(pixels, wide, height, extra)
    return _split(pixels).reshape(height, width, 4)


def chunks(data: bytes):
    """(name, content) of the file's chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("this is no WebP file")
    at = 12
    while at + 8 <= len(data):
        n = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) of the file's lossless image."""
    for name, content in chunks(data):
        if name == b"VP8L":
            return decode_vp8l(content)
    raise ValueError("the file has no lossless image")


def container(parts: list[tuple[bytes, bytes]]) -> bytes:
    body = b"WEBP" + b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1) for name, x in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def store(payload: bytes) -> bytes:
    """A file that holds the payload, a positive multiple of ``ROW`` bytes."""
    from loomspark.llm import webp_encoder

    if not payload or len(payload) % ROW:
        raise ValueError(f"the payload isn't a positive multiple of {ROW} bytes")
    if len(payload) > MAX_GREY:
        height = -(-len(payload) // (4 * MAX_SIDE))
        samples = np.frombuffer(payload + bytes(4 * MAX_SIDE * height - len(payload)), np.uint8)
        return webp_encoder.encode(samples.reshape(height, MAX_SIDE, 4))
    width = ROW
    while len(payload) > width * MAX_SIDE:
        width *= 2
    height = -(-len(payload) // width)
    return webp_encoder.encode_grey(payload + bytes(width * height - len(payload)), width, height)


def samples(pixels: np.ndarray) -> bytes:
    """The samples that ``store`` was given, out of decoded pixels."""
    if pixels.shape[1] == MAX_SIDE:
        return pixels.tobytes()
    return np.ascontiguousarray(pixels[..., 2]).tobytes()


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def feature(pixels: np.ndarray) -> str:
    """Size, and mean, deviation and number of the levels of green."""
    counts = np.bincount(pixels[..., 2].ravel(), minlength=256)
    levels, n = np.arange(256), counts.sum()
    mean = (counts * levels).sum() / n
    spread = np.sqrt((counts * (levels - mean) ** 2).sum() / n)
    return f"{pixels.shape[1]}x{pixels.shape[0]};{mean:.4f},{spread:.4f},{int((counts > 0).sum())}"


def decode_column(df: DataFrame, media: str = "media", out: str = "pixels") -> DataFrame:
    """Adds ``out``: a struct of width, height and the pixels' bytes (alpha, red, green, blue); null stays null."""

    @F.pandas_udf("struct<width:int,height:int,argb:binary>")
    def read(column):
        import pandas as pd

        found = [decode(bytes(x)) if x is not None else None for x in column]
        return pd.DataFrame({"width": [p.shape[1] if p is not None else None for p in found], "height": [p.shape[0] if p is not None else None for p in found], "argb": [p.tobytes() if p is not None else None for p in found]})

    return df.withColumn(out, F.when(F.col(media).isNotNull(), read(F.col(media))))


def round_trips(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text and reads it back; what is returned comes from the bytes read back."""

    def make():
        def work(columns):
            out = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for value in columns[1]:
                data = (value or "").encode()
                payload = pad(data)
                media = store(payload)
                pixels = decode(media)
                back = samples(pixels)[: len(payload)]
                out["n_bytes"].append(len(data))
                out["payload_bytes"].append(len(back))
                out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                out["tail_crc32"].append(zlib.crc32(back[-64:]))
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(hashlib.sha256(media).hexdigest())
                out["feature"].append(feature(pixels))
            return {"doc_id": columns[0]} | out

        return work

    picked = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(picked, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", block_rows=64)


def op8_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(documents(spark, sf_dir))
