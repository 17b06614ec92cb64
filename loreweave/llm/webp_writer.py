"""A writer of grey lossless WebP pictures, which chooses by content.

A picture of few values gets a palette, whose indices are bundled into pixels. Of
other pictures, the values or their steps to the left or upper neighbour are coded,
whichever has less entropy. Then runs that occurred before become back-references,
and what is left is coded by one of a few known prefix codes or, in a large
picture, by its own. Grey pixels gain nothing by a colour cache or by cross-colour,
which the decoder reads all the same.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache
from itertools import groupby

import numpy as np

from .webp import LENGTH_ORDER, NEAR, PALETTE, PREDICTOR, SUBTRACT_GREEN, canonical

#: Rows of a picture; more take several pictures.
MOST_ROWS = 1 << 13
#: Values that are compared to find an earlier run, the shortest and the longest copy.
_MATCH, _LEAST_COPY, _MOST_COPY = 8, 12, 4096
#: Symbols from which a picture has a prefix code of its own.
_OWN_CODE = 1 << 16
#: A step to a neighbour must save so much to be coded instead of the value.
_GAIN = 0.9
_GREEN, _OTHER, _DISTANCE = 280, 256, 40


def huffman_lengths(weights: list[int], most: int = 15) -> tuple[int, ...]:
    """Code lengths of a prefix code; weights are flattened until none is longer than most."""
    while True:
        heap = [(w, k, (k,)) for k, w in enumerate(weights) if w]
        heapq.heapify(heap)
        lengths = [0] * len(weights)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for symbol in (*a[2], *b[2]):
                lengths[symbol] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths) <= most:
            return tuple(lengths)
        weights = [w and w // 2 + 1 for w in weights]


class Code:
    """A prefix code: lengths and codes by symbol, and the bits that tell it."""

    def __init__(self, lengths: tuple[int, ...]) -> None:
        self.lengths, self.size, self.codes = lengths, np.array(lengths, np.int64), np.zeros(len(lengths), np.uint64)
        known = canonical(lengths)
        if len(known) == 1:
            self.size[known[0][0]] = 0  # the only symbol takes no bits
        else:
            for symbol, _, code in known:
                self.codes[symbol] = code
        self.head = _told(lengths, [s for s, _, _ in known])


def _told(lengths: tuple[int, ...], used: list[int]) -> list[tuple[int, int]]:
    if len(used) <= 2 and max(used) < 256:
        first, *more = sorted(used)
        wide = 8 if first > 1 else 1
        return [(1, 1), (len(more), 1), (wide == 8, 1), (first, wide), *((m, 8) for m in more)]
    # The lengths, in which 16 repeats the one before three to six times.
    last, runs = max(s for s, n in enumerate(lengths) if n) + 1, []
    for n, same in groupby(lengths[: max(last, 2)]):
        left = len(list(same)) - 1
        runs.append((n, 0))
        while left > 2 and n:
            runs.append((16, min(left, 6) - 3))
            left -= min(left, 6)
        runs += [(n, 0)] * left
    small = huffman_lengths([sum(s == k for s, _ in runs) for k in range(19)], 7)
    codes = {s: (code, n) for s, n, code in canonical(small)}
    single = len(codes) == 1
    out = [(0, 1), (len(LENGTH_ORDER) - 4, 4), *((small[k], 3) for k in LENGTH_ORDER), (1, 1), (4, 3), (len(runs) - 2, 10)]
    for s, more in runs:
        out += [codes[s]] * (not single) + [(more, 2)] * (s == 16)
    return out


@lru_cache(maxsize=1024)
def _only(symbol: int, size: int) -> Code:
    return Code(tuple(int(k == symbol) for k in range(size)))


@lru_cache(maxsize=1)
def known_codes() -> list[Code]:
    """Codes for prose, for digits and marks, and for bytes of any kind; copies are frequent in the first two."""
    orders = (" etnaoirshdlucmgwfbpyv.,\nkETAOISRHDLNUCMjxqz-'\"|0123456789", "0123456789abcdefABCDEF.,;:/-_=+ \n#*$%&<>\"'()[]{}", "")
    out = []
    for order in orders:
        weights = [1 if order else 16] * 256 + [2] * 24
        for rank, letter in enumerate(order):
            weights[ord(letter)] = 2000 // (rank + 3)
        if order:
            for b in (0xC3, 0xA9, 0xA8, 0xA4, 0xBC, 0xB6, 0xAA, 0xA7, 0xB3, 0xAD, 0xA1, 0xB1):
                weights[b] = 40
        weights[256:272] = [60] * 16  # copies of 1 to 256 values
        out.append(Code(huffman_lengths(weights)))
    return out


@lru_cache(maxsize=1)
def known_distances() -> Code:
    return Code(huffman_lengths([1] * 13 + [8] * 20 + [1] * 7))


def _amounts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes, extra bits and their number of lengths or distances."""
    d = values - 1
    high = np.floor(np.log2(np.maximum(d, 1))).astype(np.int64)
    extra = np.where(d < 4, 0, high - 1)
    prefix = np.where(d < 4, d, 2 * high + (d >> np.maximum(high - 1, 0) & 1))
    return prefix, np.where(d < 4, 0, d & (1 << extra) - 1).astype(np.uint64), extra


def _anchors(values: np.ndarray) -> np.ndarray:
    """Places where earlier runs are looked for: blanks and line ends, or, if those are rare, all."""
    places = np.flatnonzero((values == 0x20) | (values == 0x0A))
    return places[: np.searchsorted(places, values.size - _MATCH, "right")] if 16 * places.size >= values.size else np.arange(values.size - _MATCH + 1)


def copies(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, values back) of runs that occurred before, in order and without overlaps.

    Places of equal next _MATCH values are found by sorting. Where the way back
    to the latest of them stays the same from place to place, they are one run.
    """
    if values.size < 2 * _LEAST_COPY:
        return []
    places = _anchors(values)
    words = np.lib.stride_tricks.sliding_window_view(values, _MATCH)[places].view("<u8")[:, 0]
    order = np.argsort(words, kind="stable")
    same = np.flatnonzero(words[order[1:]] == words[order[:-1]])
    if not same.size:
        return []
    later, earlier = order[same + 1], order[same]
    before = np.full(places.size, -1)
    before[later] = places[earlier]
    later = np.flatnonzero(before >= 0)
    at = places[later]
    back = at - before[later]
    new = np.flatnonzero((np.diff(at) > _MATCH) | (np.diff(back) != 0)) + 1
    out, done = [], 0
    starts, ends = np.concatenate(([0], new)), np.concatenate((new - 1, [at.size - 1]))
    for first, last, d in zip(at[starts].tolist(), at[ends].tolist(), back[starts].tolist(), strict=True):
        first, until = max(first, done), last + _MATCH
        while until - first >= _LEAST_COPY:
            length = min(until - first, _MOST_COPY)
            out.append((first, length, d))
            first += length
            done = first
    return out


def _entropy(values: np.ndarray) -> float:
    counts = np.bincount(values, minlength=256)
    counts = counts[counts > 0]
    return float(counts @ np.log2(values.size / counts))


def _steps(samples: np.ndarray, mode: int) -> np.ndarray:
    """Differences to the left (mode 1) or upper (mode 2) neighbour; the first row and column have the other one."""
    out = samples.copy()
    out[0, 1:] -= samples[0, :-1]
    out[1:, 0] -= samples[:-1, 0]
    if mode == 1:
        out[1:, 1:] -= samples[1:, :-1]
    else:
        out[1:, 1:] -= samples[:-1, 1:]
    return out


def _packed(fields: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    values, sizes = zip(*fields, strict=True)
    return np.array(values, np.uint64), np.array(sizes, np.int64)


def _bytes(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Fields on end, each from its lowest bit on; none has more than 32 bits."""
    at = np.cumsum(sizes) - sizes
    total = int(at[-1] + sizes[-1])
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    words = np.zeros((total >> 6) + 2, np.uint64)
    edges = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
    # Fields don't share bits, so a word is their sum; a field may run on into the next word.
    words[word[edges]] = np.add.reduceat(values << shift, edges)
    over = np.flatnonzero((at & 63) + sizes > 64)
    words[word[over] + 1] += values[over] >> (np.uint64(64) - shift[over])
    return words.view(np.uint8)[: (total + 7) >> 3].tobytes()


def _transforms(samples: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, int]:
    """The bits that tell the transforms, the green values that are left to code, and the alpha of all pixels."""
    height, width = samples.shape
    used = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256))
    if used.size <= 16:
        wide = 1 if used.size <= 2 else 2 if used.size <= 4 else 4
        per = 8 // wide
        index = np.zeros(256, np.uint8)
        index[used] = np.arange(used.size)
        index = np.pad(index[samples], ((0, 0), (0, -width % per))).reshape(height, -1, per)
        bundled = (index << (wide * np.arange(per)).astype(np.uint8)).sum(axis=2).astype(np.uint8)
        # The palette is a picture of one row, in steps.
        steps = np.diff(used, prepend=0)
        own = Code(huffman_lengths(np.bincount(steps, minlength=_GREEN).tolist()))
        alpha = Code(huffman_lengths([int(k == 0) * (used.size - 1) + int(k == 255) for k in range(_OTHER)]))
        green = Code(tuple(own.lengths[:_GREEN]))
        colour = Code(tuple(own.lengths[:_OTHER]))
        fields = [(1, 1), (PALETTE, 2), (used.size - 1, 8), (0, 1), *green.head, *colour.head, *colour.head, *alpha.head, *_only(0, _DISTANCE).head]
        for k, step in enumerate(steps.tolist()):
            for code, symbol in ((green, step), (colour, step), (colour, step), (alpha, 255 if k == 0 else 0)):
                fields.append((int(code.codes[symbol]), int(code.size[symbol])))
        return fields, bundled, 0
    plain = _entropy(samples.reshape(-1))
    mode, left = 0, samples
    for m in (1, 2):
        steps = _steps(samples, m)
        if (e := _entropy(steps.reshape(-1))) < _GAIN * plain:
            mode, left, plain = m, steps, e / _GAIN
    fields = []
    if mode:
        # One code for all tiles, which are as large as can be: each takes no bits.
        fields = [(1, 1), (PREDICTOR, 2), (7, 3), (0, 1), *_only(mode, _GREEN).head, *_only(0, _OTHER).head * 2, *_only(255, _OTHER).head, *_only(0, _DISTANCE).head]
    return [*fields, (1, 1), (SUBTRACT_GREEN, 2)], left, 0 if mode else 255


def encode_grey(samples: np.ndarray) -> bytes:
    """uint8 samples of shape (height, width) as a WebP file, in which red, green and blue are equal."""
    height, width = samples.shape
    head, left, alpha = _transforms(samples)
    values = left.reshape(-1)
    runs = np.array(copies(values), np.int64).reshape(-1, 3)
    place, length, back = runs.T
    covered = np.zeros(values.size + 1, np.int64)
    np.add.at(covered, place, 1)
    np.add.at(covered, place + length, -1)
    free = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
    l_prefix, l_bits, l_extra = _amounts(length)
    d_prefix, d_bits, d_extra = _amounts(back + len(NEAR))
    counts = np.bincount(values[free], minlength=_GREEN)
    counts[256:] += np.bincount(l_prefix, minlength=24)
    if free.size + place.size >= _OWN_CODE:
        green = Code(huffman_lengths(counts.tolist()))
        distance = Code(huffman_lengths(np.bincount(d_prefix, minlength=_DISTANCE).tolist())) if place.size else _only(0, _DISTANCE)
    else:
        green = _only(int(values[0]), _GREEN) if counts.max() == counts.sum() else min(known_codes(), key=lambda c: int(counts @ c.size))
        distance = known_distances()
    head = [(0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 4), *head, (0, 1), (0, 1), (0, 1), *green.head, *_only(0, _OTHER).head * 2, *_only(alpha, _OTHER).head, *distance.head]
    before = np.searchsorted(place, free)
    n_head, n = len(head), len(head) + free.size + 4 * place.size
    value, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    value[:n_head], size[:n_head] = _packed(head)
    at = n_head + np.arange(free.size) + 4 * before
    value[at], size[at] = green.codes[values[free]], green.size[values[free]]
    first = n_head + np.searchsorted(free, place) + 4 * np.arange(place.size)
    told = ((green.codes[256 + l_prefix], green.size[256 + l_prefix]), (l_bits, l_extra), (distance.codes[d_prefix], distance.size[d_prefix]), (d_bits, d_extra))
    for k, (codes, sizes) in enumerate(told):
        value[first + k], size[first + k] = codes, sizes
    body = _bytes(value, size)
    body += b"\0" * (len(body) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", len(body) + 12, b"WEBP", b"VP8L", len(body)) + body
