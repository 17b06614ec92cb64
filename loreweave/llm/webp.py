"""Lossless WebP (RFC 9649): a decoder of the whole format.

It reads prefix codes, back-references and the colour cache and inverts the
predictor, cross-colour, subtract-green and palette transforms. A pixel is a 32-bit
ARGB number. Images whose red, blue and alpha codes have one symbol each take a
path that reads several green symbols at a time.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Bits that the quick path looks at; no prefix code is longer.
_LOOK = 15


class Bits:
    """Reads a byte string from the lowest bit on; behind its end there are zeros."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self) -> int:
        """The next 32 bits, and at most 7 more."""
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        return value


def canonical(lengths: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of a canonical prefix code."""
    out, code, last = [], 0, 0
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - last
        out.append((symbol, length, int(f"{code:0{length}b}"[::-1], 2)))
        code, last = code + 1, length
    if out and len(out) > 1 and code != 1 << last:
        raise ValueError("incomplete prefix code")
    return out


class Prefix:
    """Symbols of a prefix code; a code of one symbol takes no bits."""

    def __init__(self, lengths: tuple[int, ...]) -> None:
        self.lengths = lengths
        codes = canonical(lengths)
        self.only = codes[0][0] if len(codes) == 1 else 0 if not codes else None
        self.wide = max((n for _, n, _ in codes), default=0)
        if self.only is None:
            self.table = [(0, 0)] * (1 << self.wide)
            for symbol, n, code in codes:
                self.table[code :: 1 << n] = [(symbol, n)] * (1 << self.wide - n)

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        symbol, n = self.table[bits.peek() & ((1 << self.wide) - 1)]
        bits.at += n
        return symbol


#: Many images are written with the same few codes.
prefix_of = lru_cache(maxsize=32)(Prefix)


#: What told the last codes, by size: (bits, their number, code). Equal bits tell equal codes.
_told: dict[int, list[tuple[int, int, Prefix]]] = {}


def read_prefix(bits: Bits, size: int) -> Prefix:
    i, start = bits.at >> 3, bits.at
    ahead, known = int.from_bytes(bits.data[i : i + 128], "little") >> (start & 7), _told.setdefault(size, [])
    for value, n, prefix in known:
        if ahead & ((1 << n) - 1) == value:
            bits.at += n
            return prefix
    prefix = _read_prefix(bits, size)
    n = bits.at - start
    if n <= 1000:
        known.insert(0, (ahead & ((1 << n) - 1), n, prefix))
        del known[12:]
    return prefix


def _read_prefix(bits: Bits, size: int) -> Prefix:
    if bits.read(1):  # one or two symbols, written out
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths = [0] * size
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return prefix_of(tuple(lengths))
    small = [0] * len(LENGTH_ORDER)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        small[k] = bits.read(3)
    by = prefix_of(tuple(small))
    symbols = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, before = [], 8
    while len(lengths) < size and symbols:
        symbols -= 1
        code = by.read(bits)
        if code < 16:
            lengths.append(code)
            before = code or before
        elif code == 16:
            lengths += [before] * (3 + bits.read(2))
        else:
            lengths += [0] * (3 + bits.read(3) if code == 17 else 11 + bits.read(7))
    if len(lengths) > size:
        raise ValueError("too many code lengths")
    return prefix_of(tuple(lengths) + (0,) * (size - len(lengths)))


def _amount(bits: Bits, prefix: int) -> int:
    """A length or distance, from its prefix and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _back(code: int, width: int) -> int:
    """Pixels back, of a distance code."""
    if code > len(NEAR):
        return code - len(NEAR)
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The coded image before transforms, as uint32 of shape (height, width)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups_at, tile = None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        coded = _image(bits, -(-width >> tile), -(-height >> tile), False)
        groups_at = ((coded >> 8) & 0xFFFF).tolist()
    n_groups = 1 + (max(map(max, groups_at)) if groups_at else 0)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_prefix(bits, n) for n in sizes] for _ in range(n_groups)]
    green, red, blue, alpha, distance = groups[0]
    if main and n_groups == 1 and not cache_bits and None not in (red.only, blue.only, alpha.only):
        values = _greens(bits, green, distance, width, width * height).astype(np.uint32)
        return (values << 8 | np.uint32(alpha.only << 24 | red.only << 16 | blue.only)).reshape(height, width)
    out: list[int] = []
    cache, shift, cached = [0] * (1 << cache_bits), 32 - cache_bits, 0
    total = width * height
    while len(out) < total:
        at = len(out)
        y, x = divmod(at, width)
        green, red, blue, alpha, distance = groups[groups_at[y >> tile][x >> tile] if groups_at else 0]
        symbol = green.read(bits)
        if symbol < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out.append(alpha.read(bits) << 24 | r << 16 | symbol << 8 | b)
        elif symbol < 280:
            n = _amount(bits, symbol - 256)
            back = _back(_amount(bits, distance.read(bits)), width)
            if back > at:
                raise ValueError("a back-reference before the image")
            for k in range(at, min(at + n, total)):
                out.append(out[k - back])
        else:
            for p in out[cached:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            cached = at
            out.append(cache[symbol - 280])
    return np.array(out, np.uint32).reshape(height, width)


@lru_cache(maxsize=8)
def _several(lengths: tuple[int, ...]) -> list[tuple[bytes, int, int]]:
    """For every value of the next bits: the literals that they hold whole, the length symbol behind them or -1, and how many bits all those take."""
    one = prefix_of(lengths)
    out = []
    for value in range(1 << _LOOK):
        symbols, used, copy = bytearray(), 0, -1
        while True:
            symbol, n = one.table[value >> used & ((1 << one.wide) - 1)]
            if used + n > _LOOK:
                break
            used += n
            if symbol > 255:
                copy = symbol - 256
                break
            symbols.append(symbol)
        out.append((bytes(symbols), copy, used))
    return out


def _greens(bits: Bits, green: Prefix, distance: Prefix, width: int, n: int) -> np.ndarray:
    """The green values of n pixels that are told by green symbols and back-references alone."""
    if green.only is not None:
        if green.only > 255:
            raise ValueError("a back-reference before the image")
        return np.full(n, green.only, np.uint8)
    table, mask, data = _several(green.lengths), (1 << _LOOK) - 1, bits.data
    raw = np.frombuffer(data + b"\0\0", np.uint8).astype(np.uint32)
    windows = (raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16).tolist()
    at, end, out = bits.at, 8 * len(data), bytearray()
    while at < end:
        symbols, copy, used = table[windows[at >> 3] >> (at & 7) & mask]
        out += symbols
        at += used
        if copy >= 0:
            if len(out) >= n:
                break
            bits.at = at
            length = _amount(bits, copy)
            back = _back(_amount(bits, distance.read(bits)), width)
            at, start = bits.at, len(out) - back
            if start < 0:
                raise ValueError("a back-reference before the image")
            if length <= back:
                out += out[start : start + length]
            else:
                out += (out[start:] * (length // back + 1))[:length]
    if len(out) < n:
        raise ValueError("the image ends early")
    bits.at = at
    # Bits behind the last pixel may read as symbols too; they are cut off.
    return np.frombuffer(out, np.uint8)[:n]


def _planes(pixels: np.ndarray) -> np.ndarray:
    """(height, width, 4) in the order blue, green, red, alpha."""
    return pixels.astype("<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _pixels(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes).view("<u4")[..., 0]


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """The prediction from neighbours, each of four int channels."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        towards_left, towards_top = np.abs(top - top_left).sum(), np.abs(left - top_left).sum()
        return left if towards_left < towards_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        a = mean(left, top)
        d = a - top_left
        return np.clip(a + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)
    return {
        0: lambda: np.array([0, 0, 0, 255]),
        1: lambda: left,
        2: lambda: top,
        3: lambda: top_right,
        4: lambda: top_left,
        5: lambda: mean(mean(left, top_right), top),
        6: lambda: mean(left, top_left),
        7: lambda: mean(left, top),
        8: lambda: mean(top_left, top),
        9: lambda: mean(top, top_right),
        10: lambda: mean(mean(left, top_left), mean(top, top_right)),
    }.get(mode, lambda: np.array([0, 0, 0, 255]))()


def _unpredict(pixels: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    planes = _planes(pixels).astype(np.int64)
    height, width = pixels.shape
    used = np.unique(modes >> 8 & 15)
    if used.size == 1 and used[0] in (1, 2):  # sums along rows or columns
        planes[0, 0, 3] += 255
        down, right = (0, 1) if used[0] == 1 else (1, 0)
        edge = planes[:, 0] if down == 0 else planes[0]
        edge[:] = np.cumsum(edge, axis=0)
        return _pixels((np.cumsum(planes, axis=right) & 255).astype(np.uint8))
    kinds = (modes >> 8 & 15).tolist()
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = planes[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif x == 0:
                guess = planes[y - 1, 0]
            else:
                above = planes[y - 1, x + 1] if x + 1 < width else planes[y, 0]
                guess = _predicted(kinds[y >> tile][x >> tile], planes[y, x - 1], planes[y - 1, x], planes[y - 1, x - 1], above)
            planes[y, x] = planes[y, x] + guess & 255
    return _pixels(planes.astype(np.uint8))


def _uncross(pixels: np.ndarray, elements: np.ndarray, tile: int) -> np.ndarray:
    planes = _planes(pixels).copy()
    per = np.repeat(np.repeat(_planes(elements), 1 << tile, axis=0), 1 << tile, axis=1)[: pixels.shape[0], : pixels.shape[1]]
    by = lambda factor, colour: (factor.view(np.int8).astype(np.int32) * colour.view(np.int8).astype(np.int32)) >> 5
    green = np.ascontiguousarray(planes[..., 1])
    to_red, to_blue, red_to_blue = (np.ascontiguousarray(per[..., c]) for c in (0, 1, 2))
    red = np.ascontiguousarray((planes[..., 2] + by(to_red, green) & 255).astype(np.uint8))
    planes[..., 2] = red
    planes[..., 0] = planes[..., 0] + by(to_blue, green) + by(red_to_blue, red) & 255
    return _pixels(planes)


def _add_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> 8 & 255
    return (pixels & 0xFF00FF00) | ((pixels & 0x00FF00FF) + (green << 16 | green) & 0x00FF00FF)


def _unindex(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    index = (pixels >> 8 & 255).astype(np.int64)
    n = palette.size
    if n <= 16:
        wide = 8 >> (3 if n <= 2 else 2 if n <= 4 else 1)
        index = (index[..., None] >> np.arange(0, 8, wide) & ((1 << wide) - 1)).reshape(pixels.shape[0], -1)[:, :width]
    return np.r_[palette, np.zeros(256 - n, np.uint32)][index].astype(np.uint32)


def _decode_stream(data: bytes) -> np.ndarray:
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless WebP stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, coded, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            undo.append((kind, _image(bits, -(-coded >> tile), -(-height >> tile), False), tile))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = np.cumsum(_planes(_image(bits, n, 1, False)), axis=1, dtype=np.uint8)
            undo.append((kind, _pixels(table)[0], coded))
            if n <= 16:
                coded = -(-coded >> (3 if n <= 2 else 2 if n <= 4 else 1))
        else:
            undo.append((kind, None, 0))
    pixels = _image(bits, coded, height, True)
    for kind, table, n in reversed(undo):
        pixels = _unpredict(pixels, table, n) if kind == PREDICTOR else _uncross(pixels, table, n) if kind == CROSS_COLOUR else _add_green(pixels) if kind == SUBTRACT_GREEN else _unindex(pixels, table, n)
    return pixels


def decode(data: bytes) -> list[np.ndarray]:
    """The images of one or more WebP files on end: uint32 ARGB of shape (height, width)."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("no WebP file")
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        if end > len(data):
            raise ValueError("the file ends early")
        at += 12
        while at < end:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"VP8L":
                out.append(_decode_stream(data[at + 8 : at + 8 + size]))
            at += 8 + size + (size & 1)
    return out
