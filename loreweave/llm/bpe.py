"""Byte-pair encoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can't be merged across, by
any order of merges; a text is cut there for certain. White space is such a cut
on both sides, since no token holds any. The fragments are encoded on their own
and their ids concatenated. Words repeat, so a worker keeps the ids of those it
has met, up to a fixed number, and the fragments of a batch's new words are merged
together in numpy: each round joins the leftmost pair of least rank of every one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, text_of

#: Pre-tokens that a worker remembers.
REMEMBERED = 300_000
#: Longer ones are encoded, but not remembered.
LONGEST_REMEMBERED = 40
#: Texts whose new pre-tokens are merged together.
TEXTS_AT_ONCE = 256
_FAR = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable ones themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class FragmentEncoder:
    """Ids of texts under a word-end BPE file; ``ids`` and ``tokens`` of what it has read."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        # Only words with other than ASCII letters are normalised and split by the library.
        self._normalise, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self._end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_pattern = re.compile("(" + "|".join(map(re.escape, self._special)) + ")")
        # Texts of these characters are normalised by lower() and split by a plain pattern; others go through the library.
        self._simple = re.compile("[\x00-\x7f¡¿«»À-ÖØ-öø-įı-ɏ]*")
        self._parts = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^ \t-\r0-9a-zß-öø-ɏ]+")
        self.tokens = [""] * (max([*vocab.values(), *self._special.values()]) + 1)
        for token, i in [*vocab.items(), *self._special.items()]:
            self.tokens[i] = token
        self.decimals = [str(i) for i in range(len(self.tokens))]
        letters = byte_letters()
        self._letter_byte = {c: b for b, c in enumerate(letters)}
        self._plain = np.array([vocab[c] for c in letters], np.int64)
        self._final = np.array([vocab[c + self._end] for c in letters], np.int64)
        # inside[a, b]: byte b follows byte a inside some token.
        self.inside = np.zeros((256, 256), bool)
        for token in vocab:
            raw = [self._letter_byte[c] for c in token.removesuffix(self._end)]
            self.inside[raw[:-1], raw[1:]] = True
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._known: dict[str, bytes] = self._start()

    def _start(self) -> dict[str, bytes]:
        """No pre-token of a text reads like a special token, so one table holds both."""
        return {t: i.to_bytes(4, "little") for t, i in self._special.items()}

    def _pretokens(self, text: str) -> list[str]:
        if "<|" in text and len(parts := self._special_pattern.split(text)) > 1:
            return [x for k, part in enumerate(parts) for x in ([part] if k % 2 else self._pretokens(part))]
        if self._simple.fullmatch(text):
            return self._parts.findall(text.lower())
        return [bytes(map(self._letter_byte.__getitem__, piece)).decode() for piece, _ in self._split(self._normalise(text))] if text else []

    def learn(self, pretokens: list[str]) -> list[bytes]:
        """Ids of each pre-token, as little-endian 32-bit bytes."""
        raws = [p.encode() for p in pretokens]
        raw = np.frombuffer(b"".join(raws), np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        ids, last = self._plain[raw], np.cumsum(sizes) - 1
        ids[last] = self._final[raw[last]]
        # A fragment begins with a pre-token or behind a forced boundary.
        begins = np.ones(raw.size, bool)
        begins[1:] = ~self.inside[raw[:-1], raw[1:]]
        begins[last[:-1] + 1] = True
        fragment = np.cumsum(begins) - 1
        whose = np.repeat(np.arange(len(raws)), sizes)[begins]
        ids, fragment = self._merged(ids, fragment)
        flat, edges = ids.astype("<u4").tobytes(), np.cumsum(np.bincount(whose[fragment], minlength=len(raws))).tolist()
        return [flat[4 * i : 4 * j] for i, j in zip([0, *edges[:-1]], edges, strict=True)]

    def _merged(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their fragments after all merges; owner counts the fragments up."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while ids.size:
            rank = np.full(ids.size, _FAR)
            together = np.flatnonzero(owner[:-1] == owner[1:])
            key = (ids[together] << 20) | ids[together + 1]
            at = np.minimum(np.searchsorted(self._keys, key), self._keys.size - 1)
            hit = self._keys[at] == key
            # The place breaks ties, so that the leftmost of equal pairs is the least.
            rank[together[hit]] = (self._ranks[at[hit]] << 32) + together[hit]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            busy = least < _FAR
            keep = np.repeat(busy, np.diff(np.r_[starts, ids.size]))
            out.append((owner[~keep], ids[~keep]))
            first = least[busy] & 0xFFFFFFFF
            ids[first] = self._made[least[busy] >> 32]
            keep[first + 1] = False
            ids, owner = ids[keep], owner[keep]
        owner, ids = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            split = list(map(self._pretokens, texts[at : at + TEXTS_AT_ONCE]))
            new = list(set().union(*split).difference(self._known))
            if len(self._known) + len(new) > REMEMBERED:
                self._known = self._start()
                new = list(set().union(*split).difference(self._known))
            if new:
                self._known.update(zip(new, self.learn(new), strict=True))
            for pretokens in split:
                yield np.frombuffer(b"".join(map(self._known.__getitem__, pretokens)), "<u4")
            for p in new:
                if len(p) > LONGEST_REMEMBERED:
                    del self._known[p]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> FragmentEncoder:
    """The worker's encoder for a file that every worker has at this path."""
    return FragmentEncoder(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded for every row of docs.

    Null and empty texts have no ids and decode to ''. Repeated rows are encoded
    alike; a long text is one value and is read whole. No rows: no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                part = batch.iloc[at : at + TEXTS_AT_ONCE]
                ids = [x.view(np.int32) for x in e.encode(part["text"].tolist())]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "ids": ids, "decoded": [e.decode(x.tolist()) for x in ids]})

    return by_batches(docs.select("doc_id", text_of().alias("text")), run, "ids array<int>, decoded string")


def bpe_digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
