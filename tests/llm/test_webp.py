"""The lossless WebP decoder against pictures that a small scalar writer makes."""

import random
import struct

import numpy as np
import pytest

from loreweave.llm import media, webp, webp_writer

random.seed(5)


class Writer:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value, bits):
        self.value |= value << self.n
        self.n += bits

    def bytes(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def code(w, lengths):
    """Write a prefix code whose lengths come from a flat code of 4 bits; gives symbol to (value, bits)."""
    w.put(0, 1)
    w.put(15, 4)
    for k in webp.LENGTH_ORDER:
        w.put(4 if k < 16 else 0, 3)
    w.put(0, 1)
    for n in lengths:
        w.put(int(f"{n:04b}"[::-1], 2), 4)
    return {s: (c, n) for s, n, c in webp.canonical(tuple(lengths))}


def amount(n):
    """Prefix, extra bits and their number, of a length or distance code."""
    if n <= 4:
        return n - 1, 0, 0
    n -= 1
    high = n.bit_length() - 1
    second = n >> (high - 1) & 1
    return 2 * high + second, n & ((1 << high - 1) - 1), high - 1


def image(w, ops, cache_bits=0, main=True, groups=None):
    """ops: ('lit', argb), ('copy', length, distance code), ('cache', index)."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(1 if groups else 0, 1)
        if groups:
            tile, tiles = groups
            w.put(tile - 2, 3)
            image(w, [("lit", g << 8) for g in tiles], main=False)
    sets = []
    for _ in range(max(groups[1]) + 1 if groups else 1):
        green = [9] * 256 + ([6] * (24 + 8) if cache_bits else [5] * 16 + [0] * 8)
        sets.append([code(w, green), *(code(w, [8] * 256) for _ in range(3)), code(w, [5] * 32 + [0] * 8)])
    return sets


def write(w, sets, ops, at_group=None):
    for k, op in enumerate(ops):
        green, red, blue, alpha, distance = sets[at_group(k) if at_group else 0]
        if op[0] == "lit":
            p = op[1]
            for table, v in ((green, p >> 8 & 255), (red, p >> 16 & 255), (blue, p & 255), (alpha, p >> 24)):
                w.put(*table[v])
        elif op[0] == "copy":
            prefix, extra, bits = amount(op[1])
            w.put(*green[256 + prefix])
            w.put(extra, bits)
            prefix, extra, bits = amount(op[2])
            w.put(*distance[prefix])
            w.put(extra, bits)
        else:
            w.put(*green[280 + op[1]])


def sub_image(w, pixels):
    write(w, image(w, None, main=False), [("lit", int(p)) for p in pixels])


def picture(width, height, body):
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    body(w)
    data = w.bytes()
    data += b"\0" * (len(data) & 1)
    chunk = struct.pack("<4sI", b"VP8L", len(data)) + data
    return struct.pack("<4sI4s", b"RIFF", len(chunk) + 4, b"WEBP") + chunk


def some(n, colours=None):
    return [random.choice(colours) if colours else random.getrandbits(32) for _ in range(n)]


def literals(w, pixels):
    w.put(0, 1)
    write(w, image(w, None), [("lit", p) for p in pixels])


def test_back_references_and_distances():
    start = some(80)
    ops, want = [("lit", p) for p in start], list(start)
    for length, dist in ((1, 121), (7, 1), (30, 2), (5, 3), (9, 4), (200, 121 + 19), (66, 5)):
        if dist > 120:
            back = dist - 120
        else:
            dx, dy = webp.NEAR[dist - 1]
            back = max(1, dx + 20 * dy)
        ops.append(("copy", length, dist))
        for _ in range(length):
            want.append(want[-back])
    rest = -len(want) % 20
    want += some(rest)
    ops += [("lit", p) for p in want[len(want) - rest :]] if rest else []
    got = webp.decode(picture(20, len(want) // 20, lambda w: (w.put(0, 1), write(w, image(w, None), ops))))
    assert got[0].reshape(-1).tolist() == want


def test_colour_cache():
    cache, ops, want = [0] * 8, [], []
    palette = some(5)
    for _ in range(300):
        p = random.choice(palette)
        k = (0x1E35A7BD * p & 0xFFFFFFFF) >> 29
        ops.append(("cache", k) if cache[k] == p and random.random() < 0.8 else ("lit", p))
        cache[k] = p
        want.append(p)
    got = webp.decode(picture(30, 10, lambda w: (w.put(0, 1), write(w, image(w, None, cache_bits=3), ops))))
    assert got[0].reshape(-1).tolist() == want and any(o[0] == "cache" for o in ops)


def test_groups_of_codes():
    want, tiles = some(64), [0, 1, 1, 0]

    def body(w):
        w.put(0, 1)
        w.put(0, 1)
        w.put(1, 1)
        w.put(0, 3)
        sub_image(w, [g << 8 for g in tiles])
        sets = []
        for k in range(2):
            order = [9 if (s < 256) else 5 if s < 272 else 0 for s in range(280)]
            if k:
                order[0], order[256] = 5, 9
            sets.append([code(w, order), *(code(w, [8] * 256) for _ in range(3)), code(w, [5] * 32 + [0] * 8)])
        write(w, sets, [("lit", p) for p in want], lambda i: tiles[(i // 8 // 4) * 2 + i % 8 // 4])

    assert webp.decode(picture(8, 8, body))[0].reshape(-1).tolist() == want


def channels(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


def joined(cs):
    return sum((c & 255) << s for c, s in zip(cs, (24, 16, 8, 0), strict=True))


def guess(mode, left, top, top_left, top_right):
    avg = lambda *ps: [sum(x) // 2 for x in zip(*ps, strict=True)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        near_left = sum(abs(t - x) for t, x in zip(top, top_left, strict=True))
        near_top = sum(abs(a - x) for a, x in zip(left, top_left, strict=True))
        return left if near_left < near_top else top
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        return [clamp(a + int((a - c) / 2)) for a, c in zip(avg(left, top), top_left, strict=True)]
    black = [255, 0, 0, 0]
    by = [black, left, top, top_right, top_left, avg(avg(left, top_right), top), avg(left, top_left), avg(left, top), avg(top_left, top), avg(top, top_right), avg(avg(left, top_left), avg(top, top_right)), None, None, None]
    return by[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    width, height = 9, 6
    want = some(width * height)
    at = lambda x, y: channels(want[y * width + x])
    residues = []
    for y in range(height):
        for x in range(width):
            if y == 0:
                g = at(x - 1, 0) if x else [255, 0, 0, 0]
            elif x == 0:
                g = at(0, y - 1)
            else:
                g = guess(mode, at(x - 1, y), at(x, y - 1), at(x - 1, y - 1), at(x + 1, y - 1) if x + 1 < width else at(0, y))
            residues.append(joined([a - b for a, b in zip(at(x, y), g, strict=True)]))

    def body(w):
        w.put(1, 1)
        w.put(webp.PREDICTOR, 2)
        w.put(0, 3)
        sub_image(w, [mode << 8] * 6)
        literals(w, residues)

    assert webp.decode(picture(width, height, body))[0].reshape(-1).tolist() == want


def test_cross_colour_and_green():
    want, elements = some(64), some(4)
    signed = lambda v: v - 256 if v > 127 else v
    part = lambda t, c: signed(t) * signed(c) >> 5
    coded = []
    for i, p in enumerate(want):
        e = channels(elements[(i // 8 // 4) * 2 + i % 8 // 4])
        a, r, g, b = channels(p)
        coded.append(joined([a, r - part(e[3], g), g, b - part(e[2], g) - part(e[1], r)]))
    less_green = [joined([a, r - g, g, b - g]) for a, r, g, b in map(channels, coded)]

    def body(w):
        w.put(1, 1)
        w.put(webp.CROSS_COLOUR, 2)
        w.put(0, 3)
        sub_image(w, elements)
        w.put(1, 1)
        w.put(webp.SUBTRACT_GREEN, 2)
        literals(w, less_green)

    assert webp.decode(picture(8, 8, body))[0].reshape(-1).tolist() == want


@pytest.mark.parametrize("n", [2, 4, 13, 200])
def test_palette(n):
    width, height = 11, 5
    palette = some(n)
    index = [random.randrange(n) for _ in range(width * height)]
    steps = [palette[0], *(joined([a - b for a, b in zip(channels(p), channels(q), strict=True)]) for q, p in zip(palette, palette[1:], strict=False))]
    per = 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1
    packed = []
    for y in range(height):
        row = index[y * width : (y + 1) * width]
        packed += [sum(v << (8 // per * k) for k, v in enumerate(row[i : i + per])) << 8 for i in range(0, width, per)]

    def body(w):
        w.put(1, 1)
        w.put(webp.PALETTE, 2)
        w.put(n - 1, 8)
        sub_image(w, steps)
        literals(w, packed)

    assert webp.decode(picture(width, height, body))[0].reshape(-1).tolist() == [palette[i] for i in index]


def contents():
    """Payloads of many kinds, each a multiple of 64 bytes."""
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice(("the", "archive", "of", "quiet", "harbour", "lanterns", "is", "été", "42")) for _ in range(n)).encode()
    some = [bytes(64), b"x" * 64, b"xy" * 320, bytes(range(16)) * 40, bytes(range(17)) * 64, bytes(range(256)) * 3, r.randbytes(64 * 70), prose(9), prose(300), prose(40) * 30, b"0123456789abcdef" * 8 + prose(50)]
    some += [bytes((k * k // 7 + j) & 255 for k in range(40) for j in range(64)), bytes((37 * j * j + k) & 255 for k in range(80) for j in range(64)), bytes(b for b in prose(400) for _ in range(3))]
    some += [bytes(r.choice(b"ab") for _ in range(640)), bytes(r.choice(b"abc\n") for _ in range(640)), bytes(r.choice(b"abcdefgh \n") for _ in range(6400))]
    return [p.ljust(-(-len(p) // 64) * 64, b"\0") for p in some]


@pytest.mark.parametrize("k", range(17))
def test_own_pictures_by_both_paths(k, monkeypatch):
    raw = contents()[k]
    stored = media.write_pictures(raw)
    p = webp.decode(stored)[0]
    assert media.read_pictures(stored).tobytes() == raw and (p >> 24 == 255).all()
    assert (p >> 16 & 255).tolist() == (p & 255).tolist() == (p >> 8 & 255).tolist()

    def slowly(bits, green, distance, width, n):
        out = []
        while len(out) < n:
            symbol = green.read(bits)
            if symbol < 256:
                out.append(symbol)
            else:
                length = webp._amount(bits, symbol - 256)
                back = webp._back(webp._amount(bits, distance.read(bits)), width)
                for _ in range(length):
                    out.append(out[-back])
        return np.array(out[:n], np.uint8)

    monkeypatch.setattr(webp, "_greens", slowly)
    assert media.read_pictures(stored).tobytes() == raw


def test_the_writer_chooses_by_content(monkeypatch):
    seen = []
    for name in ("_unindex", "_unpredict", "_add_green", "_back"):
        monkeypatch.setattr(webp, name, lambda *a, f=getattr(webp, name), n=name: (seen.append(n), f(*a))[1])
    used = []
    for raw in contents():
        seen.clear()
        media.read_pictures(media.write_pictures(raw))
        used.append(set(seen))
    assert used[0] == {"_unindex"} and used[6] == {"_add_green"} and used[9] == {"_add_green", "_back"}
    assert "_unpredict" in used[11] and "_unpredict" in used[12] and "_unindex" in used[16]
    prose = contents()[9]
    assert len(media.write_pictures(prose)) < len(prose) / 2


def test_texts_of_several_pictures():
    r = random.Random(1)
    for raw in (r.randbytes(64 * (webp_writer.MOST_ROWS + 1)), contents()[8] * 1000, contents()[16] * 400):
        stored = media.write_pictures(raw)
        assert len(webp.decode(stored)) == -(-len(raw) // (64 * webp_writer.MOST_ROWS)) > 1
        assert media.read_pictures(stored).tobytes() == raw


def test_damaged_files_raise():
    good = media.write_pictures(bytes(64))
    for bad in (b"RIFX" + good[4:], good[:20] + b"\0" + good[21:], good[:-4]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    assert np.array_equal(webp.decode(good + good)[1], webp.decode(good)[0])
