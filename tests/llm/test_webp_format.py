"""The lossless decoder against an encoder that uses every part of the format."""

import importlib.util
import os
import random
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import webp, webp_encoder


class Writer:
    """Least significant bit first."""

    def __init__(self):
        self.value = self.n = 0

    def put(self, value, n):
        self.value |= value << self.n
        self.n += n

    def code(self, value, n):
        """Prefix codes go most significant bit first."""
        self.put(int(f"{value:0{n}b}"[::-1], 2) if n else 0, n)


def lengths_for(used, size):
    """A complete code: lengths of two neighbouring sizes."""
    out = [0] * size
    k = max(1, len(used).bit_length() - 1)
    short = (1 << (k + 1)) - len(used)
    for i, symbol in enumerate(sorted(used)):
        out[symbol] = k if i < short else k + 1
    return out


def codes_of(lengths):
    table, code, before = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        before = n
        table[symbol] = (code, n)
        code += 1
    return table


def put_code(out, used, size):
    used = sorted(used) or [0]
    if len(used) == 1 and used[0] < 256:
        for value, n in ((1, 1), (0, 1), (1, 1), (used[0], 8)):
            out.put(value, n)
        return {used[0]: (0, 0)}
    if len(used) == 1:
        used = sorted({*used, 0})
    lengths = lengths_for(used, size)
    out.put(0, 1)
    out.put(19 - 4, 4)
    for symbol in webp.LENGTH_ORDER:
        out.put(4 if symbol < 16 else 0, 3)
    out.put(0, 1)
    for n in lengths:
        out.code(n, 4)
    return codes_of(lengths)


def prefix_of(value):
    if value <= 4:
        return value - 1, 0, 0
    d = value - 1
    n = d.bit_length() - 1
    return 2 * n + (d >> (n - 1) & 1), n - 1, d & (1 << (n - 1)) - 1


def tokens_of(pixels, width, cache_bits, references):
    tokens, cache, i = [], [None] * (1 << cache_bits if cache_bits else 0), 0
    slot = lambda p: (p * webp.CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(pixels):
        best = (0, 0)
        for d in {1, 2, width - 1, width, width + 1, 3 * width + 2} if references else ():
            n = 0
            while 0 < d <= i and i + n < len(pixels) and pixels[i + n] == pixels[i + n - d] and n < 4000:
                n += 1
            best = max(best, (n, -d))
        if best[0] >= 3:
            n, d = best[0], -best[1]
            short = [k + 1 for k, (dx, dy) in enumerate(webp.NEIGHBOURS) if max(1, dx + dy * width) == d]
            tokens.append(("copy", n, short[0] if short else d + len(webp.NEIGHBOURS)))
        elif cache_bits and cache[slot(pixels[i])] == pixels[i]:
            n = 1
            tokens.append(("cache", slot(pixels[i])))
        else:
            n = 1
            tokens.append(("pixel", pixels[i]))
        for p in pixels[i : i + n]:
            if cache_bits:
                cache[slot(p)] = p
        i += n
    return tokens


def put_image(out, pixels, width, main=False, cache_bits=0, references=False, groups=None):
    """groups: (bits, number of the group of each block), for the main image."""
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    tokens = tokens_of(pixels, width, cache_bits, references)
    if main:
        out.put(1 if groups else 0, 1)
    if groups:
        bits, choice = groups
        out.put(bits - 2, 3)
        put_image(out, [g << 8 for g in choice], -(-width >> bits))
    n_groups = max(groups[1]) + 1 if groups else 1
    at, placed = 0, []
    for t in tokens:
        g = groups[1][(at // width >> groups[0]) * (-(-width >> groups[0])) + (at % width >> groups[0])] if groups else 0
        placed.append((g, t))
        at += t[1] if t[0] == "copy" else 1
    coded = []
    for g in range(n_groups):
        used = [set() for _ in range(5)]
        for own, t in placed:
            if own != g:
                continue
            if t[0] == "pixel":
                for k, shift in enumerate((8, 16, 0, 24)):
                    used[k].add(t[1] >> shift & 255)
            elif t[0] == "copy":
                used[0].add(256 + prefix_of(t[1])[0])
                used[4].add(prefix_of(t[2])[0])
            else:
                used[0].add(280 + t[1])
        coded.append([put_code(out, u, n + (1 << cache_bits if cache_bits and not k else 0)) for k, (u, n) in enumerate(zip(used, webp.ALPHABETS, strict=True))])
    for g, t in placed:
        codes = coded[g]
        if t[0] == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                out.code(*codes[k][t[1] >> shift & 255])
        elif t[0] == "copy":
            for k, v in ((0, t[1]), (4, t[2])):
                symbol, n, extra = prefix_of(v)
                out.code(*codes[k][symbol + (256 if not k else 0)])
                out.put(extra, n)
        else:
            out.code(*codes[0][280 + t[1]])
    return tokens


def start(width, height):
    out = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    return out


def finish(out):
    return webp.container([(b"VP8L", out.value.to_bytes(-(-out.n // 8), "little"))])


def argb(pixels):
    return np.array([[p >> s & 255 for s in (24, 16, 8, 0)] for p in pixels], np.uint8)


def noisy(width, height, seed, colours=None):
    pick = random.Random(seed)
    few = [pick.getrandbits(32) for _ in range(colours or 40)]
    out = []
    while len(out) < width * height:
        out += [pick.choice(few)] * pick.randrange(1, 7) if colours or pick.random() < 0.7 else [pick.getrandbits(32)]
    return out[: width * height]


def channels(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


def together(c):
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


@pytest.mark.parametrize(("cache", "references", "grouped"), [(0, False, False), (0, True, False), (1, False, False), (5, True, False), (11, True, True), (0, True, True)])
def test_entropy_coding(cache, references, grouped):
    width, height = 37, 23
    pixels = noisy(width, height, cache + 10 * references)
    out = start(width, height)
    out.put(0, 1)
    groups = (3, [random.Random(9).randrange(3) for _ in range(5 * 3)]) if grouped else None
    tokens = put_image(out, pixels, width, True, cache, references, groups)
    kinds = Counter(t[0] for t in tokens)
    assert not references or kinds["copy"]
    assert cache < 5 or kinds["cache"]
    assert (webp.decode(finish(out)).reshape(-1, 4) == argb(pixels)).all()


def clamp(v):
    return max(0, min(255, v))


def guess(mode, left, top, right, corner):
    """Of one channel; all but mode 11, which looks at all four."""
    avg = lambda a, b: (a + b) // 2
    half = avg(left, top)
    return (
        None, left, top, right, corner, avg(avg(left, right), top), avg(left, corner), avg(left, top), avg(corner, top), avg(top, right),
        avg(avg(left, corner), avg(top, right)), None, clamp(left + top - corner), clamp(half + (abs(half - corner) // 2) * (1 if half >= corner else -1)),
    )[mode]


def predicted(pixels, width, x, y, mode):
    black = [255, 0, 0, 0]
    at = lambda dx, dy: channels(pixels[(y + dy) * width + x + dx])
    if not x and not y:
        return black
    if not y:
        return at(-1, 0)
    if not x:
        return at(0, -1)
    left, top, right, corner = at(-1, 0), at(0, -1), at(1, -1), at(-1, -1)
    if mode in (0, 14, 15):
        return black
    if mode == 11:
        ends = [a + b - c for a, b, c in zip(left, top, corner, strict=True)]
        from_left = sum(abs(e - v) for e, v in zip(ends, left, strict=True))
        from_top = sum(abs(e - v) for e, v in zip(ends, top, strict=True))
        return left if from_left < from_top else top
    return [guess(mode, *v) for v in zip(left, top, right, corner, strict=True)]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height = 13, 9
    pixels = noisy(width, height, mode, colours=60)
    modes = [mode if i % 2 == 0 else (mode + 5) % 14 for i in range(4 * 3)]
    residual = []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        g = predicted(pixels, width, x, y, modes[(y >> 2) * 4 + (x >> 2)])
        residual.append(together([(a - b) & 255 for a, b in zip(channels(p), g, strict=True)]))
    out = start(width, height)
    for value, n in ((1, 1), (webp.PREDICTOR, 2), (0, 3)):
        out.put(value, n)
    put_image(out, [m << 8 for m in modes], 4)
    out.put(0, 1)
    put_image(out, residual, width, True, references=True)
    assert (webp.decode(finish(out)).reshape(-1, 4) == argb(pixels)).all()


def signed(v):
    return v - 256 if v > 127 else v


def test_cross_colour_and_green():
    width, height = 19, 10
    pixels = noisy(width, height, 3, colours=70)
    elements = [random.Random(i).getrandbits(24) | 0xFF000000 for i in range(5 * 3)]
    moved = []
    for i, p in enumerate(pixels):
        a, r, g, b = channels(p)
        # green goes first, so that both transforms are undone in turn
        r, b = (r - g) & 255, (b - g) & 255
        y, x = divmod(i, width)
        _, to_blue_from_red, to_blue, to_red = channels(elements[(y >> 2) * 5 + (x >> 2)])
        delta = lambda f, c: (signed(f) * signed(c)) >> 5
        moved.append(together([a, (r - delta(to_red, g)) & 255, g, (b - delta(to_blue, g) - delta(to_blue_from_red, r)) & 255]))
    out = start(width, height)
    for value, n in ((1, 1), (webp.SUBTRACT_GREEN, 2), (1, 1), (webp.CROSS_COLOUR, 2), (0, 3)):
        out.put(value, n)
    put_image(out, elements, 5)
    out.put(0, 1)
    put_image(out, moved, width, True, 4, True)
    assert (webp.decode(finish(out)).reshape(-1, 4) == argb(pixels)).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    width, height = 21, 11
    pixels = noisy(width, height, colours, colours=colours)
    table = sorted(set(pixels))
    bundle = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    packed_width = -(-width >> bundle)
    packed = [0] * (packed_width * height)
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        packed[y * packed_width + (x >> bundle)] |= table.index(p) << (8 + (x & (1 << bundle) - 1) * (8 >> bundle))
    steps = [together([(a - b) & 255 for a, b in zip(channels(p), channels(q), strict=True)]) for p, q in zip(table, [0, *table[:-1]], strict=True)]
    out = start(width, height)
    for value, n in ((1, 1), (webp.PALETTE, 2), (len(table) - 1, 8)):
        out.put(value, n)
    put_image(out, steps, len(table))
    out.put(0, 1)
    put_image(out, packed, packed_width, True, references=True)
    assert (webp.decode(finish(out)).reshape(-1, 4) == argb(pixels)).all()


@pytest.mark.parametrize("n", [64, 128, 4096, 64 * 16384 + 64, 3_000_000 // 64 * 64])
def test_payloads_of_any_size_and_kind(n):
    pick = random.Random(n)
    words = [bytes(pick.choices(b"abcdefghijklmnopqrstuvwxyz", k=pick.randint(2, 9))) for _ in range(500)]
    prose = b" ".join(pick.choices(words, k=n // 3))[:n].ljust(n, b".")
    for payload in (bytes(n), pick.randbytes(n), prose, bytes(pick.choices(b"ACGT", k=n)), bytes(pick.choices(b"0123456789", k=n))):
        media = webp.store(payload)
        assert webp.samples(webp.decode(media))[:n] == payload
        if n >= 4096 and payload is prose:
            assert len(media) < 0.7 * n


@pytest.mark.parametrize("size", [(1, 1), (5, 7), (33, 40), (130, 17), (64, 64)])
def test_coloured_images(size):
    """Smooth images go through predictor, cross-colour and green, noise through prefix codes alone, few colours through a palette."""
    rng = np.random.default_rng(size[0])
    y, x = np.mgrid[: size[0], : size[1]]
    smooth = (np.stack([255 + 0 * y, y * 3 + x, y + x * 2, x * y // 4], 2) + rng.integers(0, 3, (*size, 4))) & 255
    tiles = rng.integers(0, 256, (40, 4))[rng.integers(0, 40, size)]
    many = np.concatenate([smooth, smooth]) if size[0] > 5 else smooth
    for image in (smooth, many, tiles, rng.integers(0, 256, (*size, 4))):
        image = image.astype(np.uint8)
        media = webp_encoder.encode(image)
        assert (webp.decode(media) == image).all()
    if size[0] > 30:
        assert len(webp_encoder.encode(smooth.astype(np.uint8))) < 0.6 * smooth.size


def test_a_code_of_uneven_lengths_is_cut_to_fifteen_bits():
    counts = [1, 1]
    while len(counts) < 30:
        counts.append(counts[-1] + counts[-2])
    lengths = webp_encoder.code_lengths(counts)
    assert max(lengths) <= 15 and sum(2.0**-n for n in lengths) == 1


def test_a_stream_of_another_encoder():
    """The transparency of the picture in Python's own tests is a lossless stream without a header, made by another encoder."""
    found = importlib.util.find_spec("test.test_email")
    path = found and os.path.join(os.path.dirname(found.origin), "data", "python.webp")
    if not path or not os.path.exists(path):
        pytest.skip("this Python comes without its tests")
    with open(path, "rb") as file:
        parts = dict(webp.chunks(file.read()))
    alpha = parts[b"ALPH"]
    assert alpha[0] == 1
    header = webp_encoder.Fields()
    header.put((0x2F, 8), (15, 14), (15, 14), (1, 1), (0, 3))
    pixels = webp.decode_vp8l(header.data() + alpha[1:])
    levels = pixels[..., 2]
    # a symbol on clear ground that half a turn leaves much as it is
    assert pixels.shape == (16, 16, 4) and levels[0, 0] == levels[0, -1] == levels[-1, 0] == levels[-1, -1] == 0
    assert levels[0].tolist() == [0, 0, 0, 0, 175, 237, 255, 255, 255, 247, 146, 11, 3, 0, 0, 0]
    assert levels.max() == 255 and 0.2 < (levels > 200).mean() < 0.8


def test_broken_files_are_refused():
    whole = webp.store(bytes(64))
    noise = webp.store(random.Random(1).randbytes(6400))
    for data in (b"", whole[:30], noise[:300], noise[:3000], b"RIFF" + whole[4:8] + b"WAVE" + whole[12:], whole[:20] + b"\0" + whole[21:]):
        with pytest.raises(ValueError):
            webp.decode(data)


def test_column(spark):
    media = webp.store(bytes(range(64)))
    df = spark.createDataFrame([(1, bytearray(media)), (2, None)], "id int, media binary")
    rows = {r.id: r.pixels for r in webp.decode_column(df).collect()}
    assert (rows[1].width, rows[1].height) == (64, 1) and bytes(rows[1].argb) == webp.decode(media).tobytes() and rows[2] is None
