"""Lossless WebP: the writer.

An image of few colours is written through a palette, any other through the predictor, cross-colour and
subtract-green transforms. What is left is a string of pixels: back-references to equal runs of ``RUN`` pixels or more, found
by hashing every run, a colour cache where the pixels have many colours, and prefix codes of at most 15 bits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from loomspark.llm import webp

#: Pixels that are equal at least for a back-reference, and at most in one.
RUN, LONGEST = 8, 4096
#: Bytes of an image of levels from which references are looked for: in less they save little.
LEAST_SEARCHED = 2048
#: Side of the squares that choose a predictor and a cross-colour element, as a power of two; the bits of the colour cache.
SQUARE, CACHE = 4, 6
MODES = (1, 2, 5, 7, 10, 11, 12)


class Fields:
    """Numbers of given widths, the least significant bit first, as arrays that are put together at the end."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: list[tuple[int, int]] = []

    def put(self, *pairs: tuple[int, int]) -> None:
        self.waiting += pairs

    def extend(self, values: np.ndarray, widths: np.ndarray) -> None:
        self._flush()
        self.parts.append((values, widths))

    def _flush(self) -> None:
        if self.waiting:
            pairs = np.array(self.waiting, np.uint32)
            self.parts.append((pairs[:, 0], pairs[:, 1]))
            self.waiting = []

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        self._flush()
        return np.concatenate([v for v, _ in self.parts]), np.concatenate([n for _, n in self.parts]).astype(np.int64)

    def data(self) -> bytes:
        values, widths = self.all()
        ends = np.cumsum(widths)
        total = int(ends[-1])
        out = np.zeros((total + 31) // 8 + 8, np.uint8)
        room = out[: len(out) // 8 * 8].view("<u8")
        starts = ends - widths
        shifted = values.astype(np.uint64) << (starts & 31).astype(np.uint64)
        # halves of 32 bits: a field begins in one and may reach into the next; no two fields share a bit, so sums join them
        words = np.bincount(starts >> 5, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), 2 * len(room) + 1)
        words[1:] += np.bincount(starts >> 5, (shifted >> np.uint64(32)).astype(np.float64), 2 * len(room) + 1)[:-1]
        room.view("<u4")[:] = words[: 2 * len(room)].astype(np.uint64).astype(np.uint32)
        return out[: (total + 7) // 8].tobytes()


def code_lengths(counts: Sequence[int], longest: int = 15) -> list[int]:
    """Lengths of a prefix code for the symbols that occur, none over ``longest``."""
    lengths = [0] * len(counts)
    used = sorted((c, s) for s, c in enumerate(counts) if c)
    n = len(used)
    if n < 2:
        for _, s in used:
            lengths[s] = 1
        return lengths
    floor = 1
    while True:
        # leaves in order and then the nodes made of them, whose weights grow too: the least two are at the heads of these queues
        weight = [max(c, floor) for c, _ in used] + [0] * (n - 1)
        above = [0] * (2 * n - 1)
        leaf, node = 0, n
        for made in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (node >= made or weight[leaf] <= weight[node]):
                    total += weight[leaf]
                    above[leaf] = made
                    leaf += 1
                else:
                    total += weight[node]
                    above[node] = made
                    node += 1
            weight[made] = total
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[above[i]] + 1
        if max(depth) <= longest:
            for (_, s), d in zip(used, depth[:n], strict=True):
                lengths[s] = d
            return lengths
        # rarer symbols count as more, until the tree is flat enough
        floor = max(2 * floor, sum(counts) >> longest)


def codes(lengths: Sequence[int]) -> np.ndarray:
    """Each symbol's canonical code, its bits in the order in which they are written."""
    out = np.zeros(len(lengths), np.uint32)
    used, written = webp.canonical(lengths)
    out[used] = written
    return out


def _put_code(out: Fields, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code; gives codes and lengths by symbol."""
    used = np.flatnonzero(counts).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put((1, 1), (len(used) - 1, 1), (1, 1), (used[0], 8), *((s, 8) for s in used[1:]))
        lengths = np.zeros(len(counts), np.uint8)
        if len(used) == 2:
            lengths[used] = 1
        return codes(lengths.tolist()), lengths
    if len(used) == 1:
        used.append(0)
        counts = counts.copy()
        counts[0] = 1
    lengths = code_lengths(counts.tolist())
    # runs of noughts, and repetitions of another length, are one symbol
    symbols: list[int] = []
    extra: list[tuple[int, int] | None] = []
    sizes = np.array(lengths)
    edges = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), len(lengths)]
    for start, stop in zip(edges, edges[1:]):
        n, left = lengths[start], stop - start
        if n:
            symbols.append(n)
            extra.append(None)
            left -= 1
        while left > 2:
            symbol, least, bits, most = (16, 3, 2, 6) if n else (17, 3, 3, 10) if left < 11 else (18, 11, 7, 138)
            k = min(left, most)
            symbols.append(symbol)
            extra.append((k - least, bits))
            left -= k
        symbols += [n] * left
        extra += [None] * left
    of_lengths = code_lengths(np.bincount(symbols, minlength=19).tolist(), 7)
    out.put((0, 1))
    n = max(4, 1 + max(i for i, s in enumerate(webp.LENGTH_ORDER) if of_lengths[s]))
    out.put((n - 4, 4), *((of_lengths[s], 3) for s in webp.LENGTH_ORDER[:n]), (0, 1))
    own = codes(of_lengths).tolist()
    single = sum(map(bool, of_lengths)) == 1
    fields = []
    for s, more in zip(symbols, extra, strict=True):
        fields.append((own[s], 0 if single else of_lengths[s]))
        if more:
            fields.append(more)
    out.put(*fields)
    return codes(lengths), np.array(lengths, np.uint8)


def matches(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(at, length, distance) of runs that stand earlier too, from left to right, none overlapping another."""
    n = len(pixels) - RUN + 1
    if n < 2:
        return []
    exact = pixels.dtype == np.uint8
    if exact:
        key = np.ndarray(n, "<u8", np.ascontiguousarray(pixels).data, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    else:
        key = np.zeros(n, np.uint64)
        wide = pixels.astype(np.uint64)
        for i in range(RUN):
            key = key * np.uint64(0x9E3779B97F4A7C15) + wide[i : i + n]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (key >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    distance = np.zeros(n, np.int64)
    distance[order[1:][same]] = (order[1:] - order[:-1])[same]
    distance[distance > (1 << 20) - 120] = 0
    starts = np.flatnonzero(np.diff(distance, prepend=0))
    if not len(starts):
        return []
    ends = np.append(starts[1:], n)
    out, done = [], 0
    for start, end, far in zip(starts.tolist(), ends.tolist(), distance[starts].tolist(), strict=True):
        if not far:
            continue
        at, stop = max(start, done), end + RUN - 1
        # of bytes the key is the run itself, mixed in a way that can be undone; of pixels it is a hash
        if stop - at < RUN or not exact and not np.array_equal(pixels[at:stop], pixels[at - far : stop - far]):
            continue
        while stop - at >= RUN:
            length = min(LONGEST, stop - at)
            out.append((at, length, far))
            at += length
        done = at
    return out


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, extra bits, their numbers) of lengths or distances."""
    less = values - 1
    high = np.frexp(np.maximum(less, 1))[1] - 1
    extra = np.maximum(high - 1, 0)
    symbols = np.where(less < 4, less, 2 * high + (less >> extra & 1))
    extra = np.where(less < 4, 0, extra)
    return symbols, less & ((1 << extra) - 1), extra


@lru_cache(maxsize=64)
def _short(width: int) -> dict[int, int]:
    """The smallest code of each distance that a neighbour stands for."""
    found: dict[int, int] = {}
    for code, (dx, dy) in enumerate(webp.NEIGHBOURS, 1):
        found.setdefault(max(1, dx + dy * width), code)
    return found


def _cached(pixels: np.ndarray, bits: int, literal: np.ndarray) -> np.ndarray:
    """For each pixel that is a literal, its place in the colour cache if it is there just then, else -1."""
    place = ((pixels.astype(np.uint64) * np.uint64(webp.CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)
    order = np.lexsort((np.arange(len(pixels)), place))
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (place[order[1:]] == place[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    return np.where(hit & literal, place, -1)


def _references(found: list[tuple[int, int, int]], width: int) -> tuple:
    """Places of the references, and symbols, extra bits and their numbers of lengths and distances."""
    short = _short(width)
    at, length, far = np.array(found, np.int64).reshape(-1, 3).T
    far = np.array([short.get(d, d + len(webp.NEIGHBOURS)) for d in far.tolist()], np.int64)
    return at, _prefixed(length), _prefixed(far)


_NO_REFERENCES = (np.zeros(0, np.int64), (np.zeros(0, np.int64),) * 3, (np.zeros(0, np.int64),) * 3)


def _put_image(out: Fields, pixels: np.ndarray, width: int, main: bool = False, cache: int = 0) -> None:
    """An entropy-coded image of 32-bit pixels in rows, or of the levels of green alone if they are bytes; the others are 0 then and alpha is 255."""
    single = pixels.dtype == np.uint8
    found = [] if single and len(pixels) < LEAST_SEARCHED else matches(pixels)
    at, long, far = _references(found, width) if found else _NO_REFERENCES
    literal = np.ones(len(pixels), bool)
    for start, length, _ in found:
        literal[start : start + length] = False
    plain, green = literal, pixels if single else (pixels >> 8 & 255).astype(np.int64)
    if cache:
        place = _cached(pixels, cache, literal)
        plain, green = literal & (place < 0), np.where(place >= 0, 280 + place, green)
    others = [] if single else [(pixels >> shift & 255).astype(np.int64) for shift in (16, 0, 24)]
    greens = np.bincount(green[literal], minlength=280 + (1 << cache if cache else 0))
    greens[256:280] += np.bincount(long[0], minlength=24)
    out.put(*(((1, 1), (cache, 4)) if cache else ((0, 1),)), *(((0, 1),) if main else ()))
    tables = [_put_code(out, greens)]
    if single:
        # codes of one symbol: 0, 0 and 255
        out.put((1, 1), (0, 2), (0, 1), (1, 1), (0, 2), (0, 1), (1, 1), (0, 1), (1, 1), (255, 8))
    else:
        tables += [_put_code(out, np.bincount(c[plain], minlength=256)) for c in others]
    tables.append(_put_code(out, np.bincount(far[0], minlength=40)))
    first, last = tables[0], tables[-1]
    if single and not found:
        out.extend(first[0][green], first[1][green])
        return
    # four fields for each pixel: of a literal the channels, of a reference length and distance with their extra bits; those without a bit go
    values, widths = np.zeros((len(pixels), 4), np.uint32), np.zeros((len(pixels), 4), np.uint8)
    values[:, 0], widths[:, 0] = first[0][green], np.where(literal, first[1][green], 0)
    for i, (c, (code, size)) in enumerate(zip(others, tables[1:-1], strict=True), 1):
        if size.any():
            values[plain, i], widths[plain, i] = code[c[plain]], size[c[plain]]
    if len(at):
        values[at] = np.stack([first[0][256 + long[0]], long[1], last[0][far[0]], far[1]], 1)
        widths[at] = np.stack([first[1][256 + long[0]], long[2], last[1][far[0]], far[2]], 1)
    has = np.flatnonzero(widths)
    out.extend(values.ravel()[has], widths.ravel()[has])


@lru_cache(maxsize=4096)
def _palette(few: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The palette transform's fields."""
    out = Fields()
    steps = np.diff(webp._split(np.array(few, np.uint32)), axis=0, prepend=np.zeros((1, 4), np.uint8))
    out.put((1, 1), (webp.PALETTE, 2), (len(few) - 1, 8))
    _put_image(out, webp._join(steps), len(few))
    return out.all()


def _neighbours(parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Left, upper, upper right and upper left of each pixel (height, width, 4) inside; right of the last column stands the next row's first."""
    height, width, _ = parts.shape
    flat = np.concatenate([np.zeros((width + 1, 4), np.int64), parts.reshape(-1, 4).astype(np.int64)])
    n = height * width
    pick = lambda back: flat[width + 1 - back : width + 1 - back + n].reshape(parts.shape)
    return pick(1), pick(width), pick(width - 1), pick(width + 1)


def _guess(mode: int, left, top, right, corner) -> np.ndarray:
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        nearer = np.abs(top - corner).sum(2) < np.abs(left - corner).sum(2)
        return np.where(nearer[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    return {1: left, 2: top, 5: mean(mean(left, right), top), 7: mean(left, top), 10: mean(mean(left, corner), mean(top, right))}[mode]


def _squares(costs: np.ndarray, across: int, down: int, side: int) -> np.ndarray:
    """Sums of (height, width) over the squares."""
    height, width = costs.shape
    whole = np.zeros((down * side, across * side))
    whole[:height, :width] = costs
    return whole.reshape(down, side, across, side).sum((1, 3))


def _predict(out: Fields, parts: np.ndarray) -> np.ndarray:
    """The predictor transform: each square takes the mode with the least sum of residuals."""
    height, width, _ = parts.shape
    side = 1 << SQUARE
    across, down = -(-width // side), -(-height // side)
    near = _neighbours(parts)
    residuals = [((parts - _guess(mode, *near)) & 255).astype(np.uint8) for mode in MODES]
    costs = [_squares(np.abs(r.view(np.int8).astype(np.int64)).sum(2), across, down, side) for r in residuals]
    choice = np.argmin(costs, 0)
    each = np.repeat(np.repeat(choice, side, 0), side, 1)[:height, :width]
    residual = np.choose(each[..., None], residuals)
    flat = parts.astype(np.int64)
    residual[0, 1:] = (flat[0, 1:] - flat[0, :-1]) & 255
    residual[1:, 0] = (flat[1:, 0] - flat[:-1, 0]) & 255
    residual[0, 0] = (flat[0, 0] - [255, 0, 0, 0]) & 255
    out.put((1, 1), (webp.PREDICTOR, 2), (SQUARE - 2, 3))
    modes = np.array(MODES, np.uint32)[choice].ravel()
    _put_image(out, np.uint32(0xFF000000) | modes << 8, across)
    return residual


def _cross(out: Fields, parts: np.ndarray) -> np.ndarray:
    """The cross-colour transform: what green tells of red and blue, by least squares in each square."""
    height, width, _ = parts.shape
    side = 1 << SQUARE
    across, down = -(-width // side), -(-height // side)
    signed = np.ascontiguousarray(parts).view(np.int8).astype(np.int64)
    green, red, blue = signed[..., 2], signed[..., 1], signed[..., 3]
    power = np.maximum(1, _squares(green * green, across, down, side))
    factor = lambda c: np.clip(np.round(32 * _squares(green * c, across, down, side) / power), -64, 64).astype(np.int64)
    to_red, to_blue = factor(red), factor(blue)
    each = lambda f: np.repeat(np.repeat(f, side, 0), side, 1)[:height, :width]
    result = parts.copy()
    result[..., 1] = (parts[..., 1] - (each(to_red) * green >> 5)) & 255
    result[..., 3] = (parts[..., 3] - (each(to_blue) * green >> 5)) & 255
    out.put((1, 1), (webp.CROSS_COLOUR, 2), (SQUARE - 2, 3))
    _put_image(out, (np.uint32(0xFF000000) | (to_blue.ravel() & 255).astype(np.uint32) << 8 | (to_red.ravel() & 255).astype(np.uint32)), across)
    return result


def encode(parts: np.ndarray) -> bytes:
    """A file of the pixels (height, width, 4) in the order alpha, red, green, blue."""
    height, width, _ = parts.shape
    if not (0 < width <= webp.MAX_SIDE and 0 < height <= webp.MAX_SIDE):
        raise ValueError("a side is out of bounds")
    pixels = webp._join(parts.reshape(-1, 4))
    few = np.unique(pixels)
    return _file(pixels, parts, few, width, height)


def encode_grey(samples: bytes, width: int, height: int) -> bytes:
    """The same for grey pixels without transparency, of which ``samples`` has one byte each."""
    levels = np.frombuffer(samples, np.uint8)
    few = np.flatnonzero(np.bincount(levels, minlength=256)).astype(np.uint32)
    if len(few) > 16:
        # all levels between the least and the largest: a palette whose steps are equal costs a few bytes
        few = np.arange(few[0], few[-1] + 1, dtype=np.uint32)
    place = np.zeros(256, np.uint8)
    place[few] = np.arange(len(few))
    return _file(None, None, np.uint32(0xFF000000) | few * np.uint32(0x010101), width, height, place[levels])


def _file(pixels, parts, few, width, height, index=None) -> bytes:
    out = Fields()
    out.put((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3))
    if len(few) <= 256:
        if index is None:
            index = np.searchsorted(few, pixels).astype(np.uint8)
        out.extend(*_palette(tuple(few.tolist())))
        bundle = 3 if len(few) <= 2 else 2 if len(few) <= 4 else 1 if len(few) <= 16 else 0
        across = -(-width >> bundle)
        if bundle:
            room = np.zeros((height, across << bundle), np.uint8)
            room[:, :width] = index.reshape(height, width)
            shifts = (np.arange(1 << bundle) * (8 >> bundle)).astype(np.uint8)
            index = (room.reshape(height, across, -1) << shifts).sum(2, dtype=np.uint8).ravel()
        out.put((0, 1))
        _put_image(out, index, across, main=True)
    else:
        parts = _predict(out, parts)
        parts = _cross(out, parts)
        out.put((1, 1), (webp.SUBTRACT_GREEN, 2), (0, 1))
        parts = parts.copy()
        parts[..., 1] -= parts[..., 2]
        parts[..., 3] -= parts[..., 2]
        _put_image(out, webp._join(parts.reshape(-1, 4)), width, main=True, cache=CACHE)
    return webp.container([(b"VP8L", out.data())])
