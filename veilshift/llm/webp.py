"""Lossless WebP (VP8L in RIFF): a decoder for all of the format, and an encoder.

`decode` reads one image of any kind: prefix codes, groups of them, back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms. `decode_many` reads images together; those whose pixels are
literals of one prefix-code group advance in lockstep, a symbol of every image in each step, others go through `decode`.
`encode` writes one image with any of those features; `encode_literals` writes many with a fixed prefix code.
Pixels are ARGB as uint32.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from functools import cache

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
BLACK = 0xFF000000
#: Short distances are neighbours above or to the left, nearest first: those with x in -7..8, y in 0..7 before the pixel.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))
HASH = 0x1E35A7BD
LENGTHS, DISTANCES = 24, 40


class Bits:
    """Bits of a stream, lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.all = data, at, 8 * len(data)

    def read(self, n: int) -> int:
        a, self.at = self.at, self.at + n
        if self.at > self.all:
            raise ValueError("the image ends too early")
        return int.from_bytes(self.data[a >> 3 : (self.at + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)


class Prefix:
    """A canonical prefix code. A code of one symbol takes no bits."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths)
        used = np.nonzero(lengths)[0]
        if not len(used):
            used, lengths = np.zeros(1, int), np.ones(1, int)
        self.only = int(used[0]) if len(used) == 1 else None
        self.most = 0 if self.only is not None else int(lengths.max())
        if self.only is not None:
            self.table = np.array([self.only << 4], np.int32)
            return
        shares = 1 << (self.most - lengths[used])
        if int(shares.sum()) != 1 << self.most:
            raise ValueError("a prefix code isn't complete")
        order = np.argsort(lengths[used], kind="stable")
        self.table = np.repeat((used << 4 | lengths[used])[order], shares[order])[_reversed(self.most)].astype(np.int32)

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        a = bits.at
        x = int(self.table[int.from_bytes(bits.data[a >> 3 : (a >> 3) + 3], "little") >> (a & 7) & ((1 << self.most) - 1)])
        bits.at = a + (x & 15)
        if bits.at > bits.all:
            raise ValueError("the image ends too early")
        return x >> 4


@cache
def _reversed(n: int) -> np.ndarray:
    """The numbers of n bits with their bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def code_array(lengths) -> np.ndarray:
    """Canonical code of each symbol, first bit lowest; 0 for those without."""
    lengths = np.asarray(lengths, np.int64)
    used = np.nonzero(lengths)[0]
    out = np.zeros(len(lengths), np.int64)
    if len(used):
        most = int(lengths.max())
        order = used[np.argsort(lengths[used], kind="stable")]
        shares = 1 << (most - lengths[order])
        out[order] = _reversed(most)[np.cumsum(shares) - shares]
    return out


def codes(lengths) -> dict[int, int]:
    """Symbol: its canonical code, first bit lowest."""
    code = code_array(lengths).tolist()
    return {s: code[s] for s, n in enumerate(lengths) if n}


def code_lengths(weights: dict[int, float], size: int, most: int = 15) -> list[int]:
    """Lengths of a prefix code for the symbols with weights, none over `most`."""
    out = [0] * size
    if len(weights) == 1:
        out[next(iter(weights))] = 1
        return out
    floor = 0.0
    while weights:
        heap = [(max(w, floor), s, (s,)) for s, w in weights.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(weights, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= most:
            for s, n in depth.items():
                out[s] = n
            break
        floor = max(2 * floor, sum(weights.values()) / (1 << most))
    return out


# --- reading


def _read_prefix(bits: Bits, size: int) -> Prefix:
    lengths = [0] * size
    if bits.read(1):  # simple
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    first = [0] * 19
    for i in range(4 + bits.read(4)):
        first[LENGTH_ORDER[i]] = bits.read(3)
    code = Prefix(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at] = n
            at += 1
            last = n or last
        else:
            times = 3 + bits.read(2) if n == 16 else 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
            if at + times > size:
                raise ValueError("too many code lengths")
            lengths[at : at + times] = [last if n == 16 else 0] * times
            at += times
    return Prefix(lengths)


def _value(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _groups(bits: Bits, width: int, height: int, main: bool):
    """Colour cache bits, block bits and group of each block, and the prefix codes of every group."""
    cached = bits.read(4) if bits.read(1) else 0
    if cached > 11:
        raise ValueError("the colour cache is too large")
    block, which, n = 0, None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        which = (_pixels(bits, -(-width >> block), -(-height >> block), False) >> 8 & 0xFFFF).tolist()
        n = max(which) + 1
    sizes = (256 + LENGTHS + ((1 << cached) if cached else 0), 256, 256, 256, DISTANCES)
    return cached, block, which, [[_read_prefix(bits, s) for s in sizes] for _ in range(n)]


def _pixels(bits: Bits, width: int, height: int, main: bool, parsed=None) -> np.ndarray:
    cached, block, which, groups = parsed or _groups(bits, width, height, main)
    total, out = width * height, []
    cache_of = [0] * (1 << cached) if cached else []
    across, group = -(-width >> block), groups[0]
    done = 0  # pixels that the cache has seen
    data = np.frombuffer(bits.data + bytes(16), np.uint8).astype(np.uint32)
    words = (data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24).tolist()  # four bytes from each on
    tables = [[(code.table.tolist(), (1 << code.most) - 1) for code in g[:4]] for g in groups]  # a code without bits has one entry
    (greens, green), (reds, red), (blues, blue), (alphas, alpha) = tables[0]
    at, end, n = bits.at, bits.all, 0

    while n < total:
        if which:
            g = which[(n // width >> block) * across + (n % width >> block)]
            group = groups[g]
            (greens, green), (reds, red), (blues, blue), (alphas, alpha) = tables[g]
        if at > end:
            raise ValueError("the image ends too early")
        x = greens[words[at >> 3] >> (at & 7) & green]
        at += x & 15
        s = x >> 4
        if s < 256:
            x = reds[words[at >> 3] >> (at & 7) & red]
            at += x & 15
            y = blues[words[at >> 3] >> (at & 7) & blue]
            at += y & 15
            z = alphas[words[at >> 3] >> (at & 7) & alpha]
            at += z & 15
            out.append(z >> 4 << 24 | x >> 4 << 16 | s << 8 | y >> 4)
            n += 1
        elif s < 256 + LENGTHS:
            bits.at = at
            run = _value(bits, s - 256)
            d = _distance(_value(bits, group[4].read(bits)), width)
            at = bits.at
            if d > n or n + run > total:
                raise ValueError("a back-reference leaves the image")
            if d >= run:
                out += out[n - d : n - d + run]
            else:
                out += (out[n - d :] * (run // d + 1))[:run]
            n += run
        else:
            for p in out[done:]:
                cache_of[(HASH * p & 0xFFFFFFFF) >> (32 - cached)] = p
            done = n
            out.append(cache_of[s - 256 - LENGTHS])
            n += 1
    bits.at = at
    if at > end:
        raise ValueError("the image ends too early")
    return np.array(out, np.uint32)


def _transforms(bits: Bits, width: int, height: int):
    """The transforms in the order they are stored, and the width of the coded image."""
    out = []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (x[0] for x in out):
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            out.append((kind, width, block, _pixels(bits, -(-width >> block), -(-height >> block), False)))
        elif kind == SUBTRACT_GREEN:
            out.append((kind, width, 0, None))
        else:
            n = bits.read(8) + 1
            table = _pixels(bits, n, 1, False)
            channels = np.cumsum(table.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            out.append((kind, width, pack, channels.view(np.uint32).ravel()))
            width = -(-width >> pack)
    return out, width


def _delta(t, c):
    return (t.astype(np.int8).astype(np.int32) * c.astype(np.int8).astype(np.int32)) >> 5


def _blocks(image: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    """The element of a block image that holds for each pixel."""
    grid = image.reshape(-(-height >> block), -(-width >> block))
    return grid[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block].ravel()


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _by_channel(f, *pixels: int) -> int:
    return sum(f(*[p >> k & 255 for p in pixels]) << k for k in (0, 8, 16, 24))


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _select(left: int, top: int, corner: int) -> int:
    """Of left and top the one nearer to left + top - corner."""
    by = [sum(abs((x >> k & 255) - (corner >> k & 255)) for k in (0, 8, 16, 24)) for x in (top, left)]
    return left if by[0] < by[1] else top


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """corner: above left; right: above right."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _average(_average(left, right), top)
        case 6:
            return _average(left, corner)
        case 7:
            return _average(left, top)
        case 8:
            return _average(corner, top)
        case 9:
            return _average(top, right)
        case 10:
            return _average(_average(left, corner), _average(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return _by_channel(lambda a, b, c: _clamp(a + b - c), left, top, corner)
        case 13:
            return _by_channel(lambda a, c: _clamp(a + int((a - c) / 2)), _average(left, top), corner)
    return BLACK


def _prediction(out, at: int, width: int, mode: int) -> int:
    """out holds at least all pixels before `at`."""
    x, y = at % width, at // width
    if not y:
        return out[at - 1] if x else BLACK
    if not x:
        return out[at - width]
    # above the last pixel's right is the first of its own row
    return predict(mode, out[at - 1], out[at - width], out[at - width - 1], out[at - width + 1])


def _sum(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _difference(a: int, b: int) -> int:
    return _by_channel(lambda x, y: (x - y) & 255, a, b)


def _invert(pixels: np.ndarray, height: int, transform) -> np.ndarray:
    kind, width, k, image = transform
    if kind == PREDICTOR:
        modes, out = (_blocks(image, width, height, k) >> 8 & 15).tolist(), []
        for at, p in enumerate(pixels.tolist()):
            out.append(_sum(p, _prediction(out, at, width, modes[at])))
        return np.array(out, np.uint32)
    if kind == PALETTE:
        if k:
            each, bits = 1 << k, 8 >> k
            green = (pixels >> 8 & 255).reshape(height, -1, 1)
            index = (green >> (np.arange(each, dtype=np.uint32) * bits) & ((1 << bits) - 1)).reshape(height, -1)[:, :width].ravel()
        else:
            index = pixels >> 8 & 255
        return np.append(image, np.zeros(256, np.uint32))[index]
    c = pixels.view(np.uint8).reshape(-1, 4).copy()  # blue, green, red, alpha
    if kind == SUBTRACT_GREEN:
        c[:, 0] += c[:, 1]
        c[:, 2] += c[:, 1]
    else:
        e = _blocks(image, width, height, k).view(np.uint8).reshape(-1, 4)  # green to red, green to blue, red to blue
        red = (c[:, 2] + _delta(e[:, 0], c[:, 1])).astype(np.uint8)
        c[:, 0] = (c[:, 0] + _delta(e[:, 1], c[:, 1]) + _delta(e[:, 2], red)).astype(np.uint8)
        c[:, 2] = red
    return c.view(np.uint32).ravel()


def stream_of(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The VP8L stream of the file that begins at `at`, and where the file ends."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size, n = struct.unpack_from("<I", data, at + 4)[0], struct.unpack_from("<I", data, at + 16)[0]
    if at + 20 + n > len(data) or data[at + 20] != 0x2F:
        raise ValueError("a broken WebP file")
    return data[at + 20 : at + 20 + n], at + 8 + size


def _shape(stream: bytes) -> tuple[int, int]:
    x = int.from_bytes(stream[1:5], "little")
    if x >> 29:
        raise ValueError("unknown version")
    return (x & 0x3FFF) + 1, (x >> 14 & 0x3FFF) + 1


def decode(stream: bytes) -> np.ndarray:
    """Pixels (height, width) of one stream."""
    width, height = _shape(stream)
    bits = Bits(stream, 40)
    transforms, coded = _transforms(bits, width, height)
    pixels = _pixels(bits, coded, height, True)
    for t in reversed(transforms):
        pixels = _invert(pixels, height, t)
    return pixels.reshape(height, width)


#: Headers without transforms that were read before: bits, their number, parsed.
_heads: list[tuple[int, int, tuple]] = []


def _head(stream: bytes):
    """What follows the size of an image without transforms: (bits, parsed); None with transforms."""
    front = int.from_bytes(stream[5:800], "little")
    for value, n, parsed in _heads:
        if front & ((1 << n) - 1) == value and 40 + n <= 8 * len(stream):
            return n, parsed
    bits = Bits(stream, 40)
    width, height = _shape(stream)
    if bits.read(1):
        return None
    parsed, n = _groups(bits, width, height, True), bits.at - 40
    if n <= 6000 and len(_heads) < 8:
        _heads.append((front & ((1 << n) - 1), n, parsed))
    return n, parsed


def decode_many(streams: list[bytes]) -> list[np.ndarray]:
    """Pixels of each stream, as `decode` gives them."""
    out: list = [None] * len(streams)
    plain: dict[int, list] = {}
    kinds = {}
    for i, s in enumerate(streams):
        found = _head(s)
        if found is None or found[1][0] or found[1][2] is not None:
            out[i] = decode(s)
        else:
            kinds[id(found[1])] = found[1]
            plain.setdefault(id(found[1]), []).append((i, found[0]))
    for k, which in plain.items():
        shapes = {i: _shape(streams[i]) for i, _ in which}
        which.sort(key=lambda x: -shapes[x[0]][0] * shapes[x[0]][1])
        for (i, _), pixels in zip(which, _lockstep([streams[i] for i, _ in which], [n for _, n in which], [shapes[i][0] * shapes[i][1] for i, _ in which], kinds[k][3][0]), strict=True):
            out[i] = decode(streams[i]) if pixels is None else pixels.reshape(shapes[i][1], shapes[i][0])
    return out


def _lockstep(streams, heads, sizes, group) -> list:
    """Pixels of streams sorted by size, largest first; None for one that isn't of literals."""
    data = np.frombuffer(b"".join(streams) + bytes(24), np.uint8).astype(np.uint32)
    words = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24  # four bytes from each on
    lengths = np.array([len(s) for s in streams], np.int64)
    starts = np.cumsum(lengths) - lengths
    at = starts * 8 + 40 + np.array(heads)
    n = np.array(sizes)
    active = np.searchsorted(-n, -np.arange(n[0]), side="left")  # those with more pixels than so many
    symbols = np.zeros((n[0], 4, len(streams)), np.uint16)
    for t in range(n[0]):
        k = active[t]
        p = at[:k]
        for c, code in ((1, group[0]), (2, group[1]), (0, group[2]), (3, group[3])):
            if code.only is not None:
                symbols[t, c, :k] = code.only
                continue
            x = code.table[(words[p >> 3] >> (p & 7).astype(np.uint32)) & ((1 << code.most) - 1)]
            symbols[t, c, :k] = x >> 4
            p += x & 15
        np.minimum(p, 8 * (len(words) - 16), out=p)  # after a back-reference the rest means nothing
    bad = (symbols[:, 1] > 255).any(axis=0) | (at > (starts + lengths) * 8)
    channels = symbols.astype(np.uint8)
    return [None if bad[i] else np.ascontiguousarray(channels[: n[i], :, i]).view(np.uint32).ravel() for i in range(len(streams))]


# --- writing


class Writer:
    def __init__(self):
        self.bits, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.bits |= value << self.n
        self.n += n

    def put_many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """put each value; its bits over sizes are 0, sizes are under 32."""
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return
        at, plane = ends - sizes, np.zeros(int(ends[-1]), np.uint8)
        for k in range(int(sizes.max())):
            which = sizes > k
            at, values, sizes = at[which], values[which], sizes[which]
            plane[at + k] = values >> k & 1
        self.put(int.from_bytes(np.packbits(plane, bitorder="little").tobytes(), "little"), int(ends[-1]))

    def bytes(self) -> bytes:
        return self.bits.to_bytes((self.n + 7) // 8, "little")


def _put_prefix(w: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used) and all(lengths[s] == 1 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return
    tokens, at = [], 0  # (symbol, extra, bits of it)
    while at < len(lengths):
        run = 1
        while at + run < len(lengths) and lengths[at + run] == lengths[at]:
            run += 1
        if lengths[at] or run < 3:
            tokens.append((lengths[at], 0, 0))
            at += 1
        else:
            run = min(run, 138)
            tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
            at += run
    first = code_lengths(Counter(t[0] for t in tokens), 19, 7)
    code = codes(first)
    w.put(0, 1)
    w.put(15, 4)
    for s in LENGTH_ORDER:
        w.put(first[s], 3)
    w.put(0, 1)
    for s, extra, n in tokens:
        if len(code) > 1:
            w.put(code[s], first[s])
        w.put(extra, n)


def _before(keys: np.ndarray) -> np.ndarray:
    """The last earlier place of each place's key, -1 if there is none."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1, np.int64)
    again = np.nonzero(keys[order[1:]] == keys[order[:-1]])[0]
    out[order[again + 1]] = order[again]
    return out


@cache
def _near(width: int) -> dict[int, int]:
    """Distance in pixels: the code of the nearest neighbour that lies so far back."""
    return {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}


def _prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * extra + 2 + (v >> extra & 1), v & ((1 << extra) - 1), extra


def _put_pixels(w: Writer, pixels: list[int], width: int, main: bool, cached: int = 0, matches: bool = False, split: int = 0) -> None:
    """split: block bits of two groups of prefix codes, by turns."""
    w.put(bool(cached), 1)
    if cached:
        w.put(cached, 4)
    height = len(pixels) // width
    across, n = -(-width >> split), 1
    group = lambda at: 0
    if main:
        w.put(bool(split), 1)
        if split:
            n = 2
            group = lambda at: ((at % width >> split) + (at // width >> split)) % 2
            w.put(split - 2, 3)
            _put_pixels(w, [BLACK | (x + y) % 2 << 8 for y in range(-(-height >> split)) for x in range(across)], across, False)
    of = np.array(pixels, np.int64)
    # tokens: where they begin, then green or length or cache symbol, and up to four further fields
    kept, runs = np.ones(len(of), bool), []  # a token begins here; (where, length, distance)
    if matches and len(of) > 3:
        colour = np.unique(of, return_inverse=True)[1].astype(np.int64)
        triple = (colour[:-2] * len(of) + colour[1:-1]) * len(of) + colour[2:] if len(of) < 1 << 21 else None
        if triple is None:
            raise ValueError("the image is too large for back-references")
        before = _before(triple)
        places, at = np.nonzero(before >= 0)[0].tolist(), 0
        earlier = before.tolist()
        for place in places:
            if place < at:
                continue
            b, run, most = earlier[place], 3, min(4096, len(of) - place)
            while run < most and pixels[b + run] == pixels[place + run]:
                run += 1
            runs.append((place, run, place - b))
            at = place + run
            kept[place + 1 : at] = False
    where = np.nonzero(kept)[0]
    kind = np.zeros(len(of), np.int8)  # 0: literal, 1: from the cache, 2: back-reference
    symbol = of >> 8 & 255
    if cached:
        slot = (HASH * of & 0xFFFFFFFF) >> (32 - cached)
        before = _before(slot)
        hit = (before >= 0) & (of[before] == of)
        kind[hit], symbol[hit] = 1, 256 + LENGTHS + slot[hit]
    near, extras = _near(width), []
    for place, run, d in runs:
        length, far = _prefix_of(run), _prefix_of(near.get(d, d + len(NEAR)))
        kind[place], symbol[place] = 2, 256 + length[0]
        extras.append((*length[1:], *far))
    extras = np.array(extras, np.int64).reshape(-1, 5)
    groups = np.zeros(len(of), np.int64)
    if n > 1:
        i = np.arange(len(of))
        groups = ((i % width >> split) + (i // width >> split)) % 2
    kind, symbol, groups, of = kind[where], symbol[where], groups[where], of[where]
    literal, copied = kind == 0, kind == 2
    values, sizes = np.zeros((len(where), 5), np.int64), np.zeros((len(where), 5), np.int64)
    values[copied, 1], sizes[copied, 1] = extras[:, 0], extras[:, 1]
    values[copied, 3], sizes[copied, 3] = extras[:, 3], extras[:, 4]
    far = np.zeros(len(where), np.int64)
    far[copied] = extras[:, 2]
    # the field of each code, the tokens that use it, its symbols
    fields = ((0, np.ones(len(where), bool), symbol, 256 + LENGTHS + ((1 << cached) if cached else 0)), (1, literal, of >> 16 & 255, 256), (2, literal, of & 255, 256), (3, literal, of >> 24, 256), (2, copied, far, DISTANCES))
    for g in range(n):
        for field, users, symbols, size in fields:
            which = users & (groups == g)
            counts = np.bincount(symbols[which], minlength=size)
            used = np.nonzero(counts)[0]
            lengths = code_lengths(dict(zip(used.tolist(), counts[used].tolist(), strict=True)), size)
            _put_prefix(w, lengths)
            if len(used) > 1:
                values[which, field], sizes[which, field] = code_array(lengths)[symbols[which]], np.array(lengths)[symbols[which]]
    w.put_many(values.ravel(), sizes.ravel())


def file_of(stream: bytes) -> bytes:
    pad = bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def encode(pixels: np.ndarray, predictor: int | None = None, cross=None, subtract_green: bool = False, palette: bool = False, cached: int = 0, matches: bool = False, split: int = 0) -> bytes:
    """The stream of one image, pixels (height, width) as uint32. predictor: mode; cross: (green to red, green to blue, red to blue)."""
    height, width = pixels.shape
    flat, block = pixels.astype(np.uint32).ravel(), 3
    w = Writer()
    w.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    coded = width
    count = (-(-width >> block)) * (-(-height >> block))
    if palette:
        table, index = np.unique(flat, return_inverse=True)
        if len(table) > 256:
            raise ValueError("too many colours for a palette")
        pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
        w.put(1 | PALETTE << 1 | (len(table) - 1) << 3, 11)
        steps = np.diff(table.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
        _put_pixels(w, np.ascontiguousarray(steps).view(np.uint32).ravel().tolist(), len(table), False)
        coded = -(-width >> pack)
        grid = np.zeros((height, coded << pack), np.uint32)
        grid[:, :width] = index.reshape(height, width)
        shift = np.arange(1 << pack, dtype=np.uint32) * (8 >> pack)
        flat = (np.bitwise_or.reduce(grid.reshape(height, coded, -1) << shift, axis=2) << 8 | BLACK).ravel().astype(np.uint32)
        count = (-(-coded >> block)) * (-(-height >> block))
    if predictor is not None:
        w.put(1 | PREDICTOR << 1 | (block - 2) << 3, 6)
        _put_pixels(w, [BLACK | predictor << 8] * count, -(-coded >> block), False)
        of = flat.tolist()
        flat = np.array([_difference(p, _prediction(of, i, coded, predictor)) for i, p in enumerate(of)], np.uint32)
    if cross is not None:
        w.put(1 | CROSS_COLOUR << 1 | (block - 2) << 3, 6)
        _put_pixels(w, [BLACK | (cross[2] & 255) << 16 | (cross[1] & 255) << 8 | (cross[0] & 255)] * count, -(-coded >> block), False)
        c = flat.view(np.uint8).reshape(-1, 4).copy()
        t = np.array(cross, np.int64).astype(np.uint8)
        c[:, 0] = (c[:, 0] - _delta(t[1:2], c[:, 1]) - _delta(t[2:3], c[:, 2])).astype(np.uint8)
        c[:, 2] = (c[:, 2] - _delta(t[0:1], c[:, 1])).astype(np.uint8)
        flat = c.view(np.uint32).ravel()
    if subtract_green:
        w.put(1 | SUBTRACT_GREEN << 1, 3)
        c = flat.view(np.uint8).reshape(-1, 4).copy()
        c[:, 0] -= c[:, 1]
        c[:, 2] -= c[:, 1]
        flat = c.view(np.uint32).ravel()
    w.put(0, 1)
    _put_pixels(w, flat.tolist(), coded, True, cached, matches, split)
    return w.bytes()


@cache
def _text_code():
    """A fixed code for bytes of text: frequent letters first, then ASCII, then the rest. Its header's bits, codes and lengths."""
    often = b" etaonrishdlucmfpgwybvk.,\n"
    weight = {b: 1 / (2 + often.index(b)) if b in often else 1 / 150 if 32 <= b < 127 else 1 / 100 if b in (0xC3, 0xC2) else 1 / 400 for b in range(256)}
    lengths = code_lengths(weight, 256, 12)
    w = Writer()
    w.put(0, 1)  # no transform
    w.put(0, 1)  # no colour cache
    w.put(0, 1)  # one group
    for n in ([*lengths, *[0] * LENGTHS], lengths, lengths):
        _put_prefix(w, n)
    _put_prefix(w, [0] * 255 + [1])
    _put_prefix(w, [1] + [0] * (DISTANCES - 1))
    code = codes(lengths)
    return w.bits, w.n, np.array([code[b] for b in range(256)], np.uint32), np.array(lengths, np.int64)


def encode_literals(samples: list[bytes], width: int) -> list[bytes]:
    """The files of many images of RGB samples, rows of `width` pixels, with a fixed prefix code."""
    if not samples:
        return []
    value, n, code, length = _text_code()
    head = np.unpackbits(np.frombuffer(value.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
    every = np.frombuffer(b"".join(samples), np.uint8).reshape(-1, 3)[:, [1, 0, 2]].ravel()
    sizes = np.array([len(s) for s in samples])
    bits = length[every]
    ends = np.cumsum(bits)
    last = np.cumsum(sizes) - 1
    used = np.diff(ends[last], prepend=0)  # bits of pixels, for each image
    room = (n + used + 7) // 8 * 8
    starts = np.cumsum(room) - room
    at = ends - bits + np.repeat(starts + n - (ends[last] - used), sizes)
    plane = np.zeros(int(room.sum()), np.uint8)
    plane[(starts[:, None] + np.arange(n)).ravel()] = np.tile(head, len(samples))
    value_of = code[every]
    for k in range(int(length.max())):
        if k >= length.min():
            which = bits > k
            at, value_of, bits = at[which], value_of[which], bits[which]
        plane[at + k] = value_of >> k & 1
    data = np.packbits(plane, bitorder="little").tobytes()
    out = []
    for size, a, b in zip(sizes.tolist(), (starts // 8).tolist(), ((starts + room) // 8).tolist(), strict=True):
        shape = (0x2F | (width - 1) << 8 | (size // (3 * width) - 1) << 22).to_bytes(5, "little")
        out.append(file_of(shape + data[a:b]))
    return out
