"""Vector expressions, in double precision."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def cosine_safe(a: Column, b: Column) -> Column:
    """0 for empty vectors and unequal lengths; every norm is raised by 1e-8."""
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(dot(a, b) / ((norm(a) + F.lit(1e-8)) * (norm(b) + F.lit(1e-8))))


#: White space as Python's str.strip knows it.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def hash_tokens(text: Column) -> Column:
    """Distinct characters (c:) and neighbouring characters (b:) of a trimmed text, and its words (w:) in lower case."""
    stripped = F.btrim(text, F.lit(BLANKS))
    visible = lambda x: F.btrim(x, F.lit(BLANKS)) != ""

    def tokens(characters: Column) -> Column:
        # Distinct ones first: a text has few characters and pairs of them.
        pairs = F.array_compact(F.zip_with(characters, F.slice(characters, 2, F.greatest(F.size(characters), F.lit(1))), lambda a, b: F.concat(a, b)))
        tagged = lambda tag, found: F.transform(F.filter(F.array_distinct(found), visible), lambda x: F.concat(F.lit(tag), x))
        return F.concat(tagged("c:", characters), tagged("b:", pairs))

    words = F.array_distinct(F.transform(F.regexp_extract_all(stripped, F.lit("([A-Za-z0-9]+|[\u4e00-\u9fff]+)"), F.lit(1)), lambda w: F.lower(w)))
    return F.concat(bind(F.filter(F.split(stripped, ""), lambda c: c != ""), tokens), F.transform(words, lambda w: F.concat(F.lit("w:"), w)))


CELLS = "array<struct<idx:int,weight:double>>"

#: Hashes of tokens that a worker remembers of each kind, numbers of texts' cells and of their characters that it holds at once, and flags by which it finds distinct tokens.
REMEMBERED, HELD, FLAGS = 1 << 18, 1 << 19, 1 << 24


class _Hashes(dict):
    """The hashes of tokens of one kind, the first eight hexadecimal digits of their MD5; -1 for white space."""

    def __init__(self, tag: Callable[[str], str]) -> None:
        super().__init__()
        self._tag = tag

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = int.from_bytes(hashlib.md5(f"{self._tag(token)}:{token}".encode()).digest()[:4], "big") if token.strip(BLANKS) else -1
        self[token] = found
        return found


_LETTERS, _WORDS = _Hashes(lambda t: "c" if len(t) == 1 else "b"), _Hashes(lambda t: "w")


def _distinct(keys: np.ndarray, limit: int) -> np.ndarray:
    """The distinct keys below limit, in order."""
    if limit <= FLAGS:
        seen = np.zeros(limit, bool)
        seen[keys] = True
        return np.flatnonzero(seen)
    keys = np.sort(keys.astype(np.int32) if limit < 1 << 31 else keys)
    return keys[np.diff(keys, prepend=-1) != 0]


def _placed(token: np.ndarray, row: np.ndarray, tokens: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of n rows in order, in how many rows each is, and those rows."""
    key = _distinct(token.astype(np.int32 if tokens * n < 1 << 31 else np.int64) * n + row, tokens * n).astype(np.int64)
    token = key // n
    starts = np.flatnonzero(np.diff(token, prepend=-1))
    return token[starts], np.diff(starts, append=len(key)), key - token * n


def _numbered(keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys below limit, in order, and the place of each key among them."""
    if limit > FLAGS:
        return np.unique(keys, return_inverse=True)
    known = _distinct(keys, limit)
    place = np.zeros(limit, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    return known, place[keys]


def _hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of texts' tokens, as hash_tokens tells them, and the texts' places. Each token is looked up once for all texts."""
    stripped = [(t or "").strip(BLANKS) for t in texts]
    n, lengths = len(texts), np.fromiter(map(len, stripped), np.int64, len(texts))
    row, code = np.repeat(np.arange(n, dtype=np.int32), lengths), np.frombuffer("".join(stripped).encode("utf-32-le"), np.uint32)
    # Characters are told by their places among the distinct ones, and so are pairs.
    known, c = _numbered(code, int(code.max(initial=0)) + 1)
    within = row[1:] == row[:-1]
    letters, of_rows, of_letters = _placed(c, row, len(known), n)
    wide = np.int32 if len(known) ** 2 < 1 << 31 else np.int64
    met, pair = _numbered((c[:-1].astype(wide) * len(known) + c[1:])[within], len(known) ** 2)
    pairs, in_rows, of_pairs = _placed(pair, row[1:][within], len(met), n)
    # Words are runs of one kind: ASCII letters and digits, or Chinese characters.
    kinds = np.where((known >= 0x4E00) & (known <= 0x9FFF), 2, ((known >= 48) & (known <= 57)) | (((known | 32) >= 97) & ((known | 32) <= 122))).astype(np.int8)
    kind = kinds[c]
    spelt = kind > 0
    begins = np.flatnonzero(spelt & np.concatenate(([True], ~within | (kind[1:] != kind[:-1])))[: len(kind)])
    narrow = not (kinds == 2).any()
    lower = np.where((known >= 65) & (known <= 90), known | 32, known).astype(np.uint8 if narrow else np.dtype("<u4"))[c[spelt]]
    ends = np.append(np.cumsum(spelt)[begins] - 1, len(lower)) * lower.itemsize
    words = pa.Array.from_buffers(pa.large_string() if narrow else pa.large_binary(), len(begins), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(lower)]).dictionary_encode()
    vocabulary = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    vocabulary = vocabulary if narrow else [w.decode("utf-32-le") for w in vocabulary]
    told, of_words, in_texts = _placed(words.indices.to_numpy(), row[begins], len(vocabulary), n)
    characters, met = [chr(x) for x in known.tolist()], met.tolist()
    found = (
        ([_LETTERS[characters[x]] for x in letters.tolist()], of_rows, of_letters),
        ([_LETTERS[characters[met[x] // len(known)] + characters[met[x] % len(known)]] for x in pairs.tolist()], in_rows, of_pairs),
        ([_WORDS[vocabulary[x]] for x in told.tolist()], of_words, in_texts),
    )
    h = np.concatenate([np.repeat(np.array(hashes, np.int64), times) for hashes, times, _ in found])
    where = np.concatenate([r for _, _, r in found])
    return h[h >= 0], where[h >= 0]


def _sums(texts: list[str | None], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of cells of each text, the cells' places and sums of signs, and each text's length."""
    h, row = _hashes(texts)
    sums = np.bincount(row * dim + h % dim, 1.0 - 2 * (h >> 31), len(texts) * dim).reshape(-1, dim)
    length = np.sqrt((sums * sums).sum(axis=1)) + 1e-8  # of whole numbers, so exact
    cells = np.flatnonzero(sums != 0)
    return np.count_nonzero(sums, axis=1), cells % dim, sums.reshape(-1)[cells], length


def embedded_sums(texts: list[str | None], dim: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What _sums tells, for a batch of any size. A cell's weight is its sum through its text's length."""
    parts, at, step = [], 0, max(1, HELD // dim)
    while at < len(texts) or not parts:
        end, held = at, 0
        while end < len(texts) and end - at < step and (end == at or held + len(texts[end] or "") <= HELD):
            held, end = held + len(texts[end] or ""), end + 1
        parts.append(_sums(texts[at:end], dim))
        at = end
    n, idx, sums, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    return n, idx, sums, length


def _cells(texts: list[str | None], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of cells of each text, and the cells' places and weights."""
    n, idx, sums, length = embedded_sums(texts, dim)
    return n, idx, sums / np.repeat(length, n)


def hash_cells(text: Column, dim: int = 512) -> Column:
    """The non-zero cells of a signed feature hash of a text, of length 1, in order: array<struct<idx, weight>>, made inside the row.

    A token's hash is the first eight hexadecimal digits of its MD5; its highest
    bit gives the sign. Texts repeat their tokens, so a worker remembers the hashes
    and sums up a batch of texts at once. Null and blank texts: no cells.
    """

    def cells(texts: pa.Array) -> pa.Array:
        n, idx, weight = _cells(texts.to_pylist(), dim)
        made = pa.StructArray.from_arrays([pa.array(idx.astype(np.int32)), pa.array(weight)], ["idx", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), made)

    return F.arrow_udf(cells, CELLS)(text)


def hash_embedding(docs: DataFrame, keys: str | list[str], text: str, dim: int = 512) -> DataFrame:
    """keys, idx, weight: the cells of every text, one to a row. Nothing is shuffled."""
    return docs.select(*([keys] if isinstance(keys, str) else keys), F.inline(hash_cells(F.col(text), dim)))
