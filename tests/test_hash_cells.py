"""The hash embedding of batches of texts against its definition by hash_tokens."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loreweave.functions import vectors as V

TEXTS = [None, "", " 　\n", "a", " Ab  aB 中文中 x\x1c", "😀😀 é é _-_ ab12AB", "word " * 300, "퟿￿", "a\x00b"]


@pytest.mark.parametrize("dim", [512, 7])
@pytest.mark.parametrize("remembered, held", [(1 << 18, 1 << 19), (2, 8)])
def test_cells_are_those_of_the_tokens(spark, monkeypatch, dim, remembered, held):
    monkeypatch.setattr(V, "REMEMBERED", remembered)
    monkeypatch.setattr(V, "HELD", held)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    tokens = {r[0]: r[1] for r in rows.select("k", V.hash_tokens(F.col("t"))).collect()}
    n, idx, weight = V._cells(TEXTS, dim)
    told = {r[0]: [tuple(c) for c in r[1]] for r in rows.select("k", V.hash_cells(F.col("t"), dim)).collect()}
    at = 0
    for k in range(len(TEXTS)):
        sums = Counter()
        for t in tokens[k] or []:
            h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
            sums[h % dim] += -1 if h >> 31 else 1
        length = math.sqrt(sum(w * w for w in sums.values())) + 1e-8
        want = [(i, w / length) for i, w in sorted(sums.items()) if w]
        assert told[k] == want == list(zip(idx[at : at + n[k]], weight[at : at + n[k]], strict=True))
        at += n[k]


def test_a_token_is_hashed_once_for_many_texts(monkeypatch):
    made = []
    md5 = hashlib.md5
    monkeypatch.setattr(V.hashlib, "md5", lambda b: made.append(b) or md5(b))
    monkeypatch.setattr(V, "_LETTERS", V._Hashes(lambda t: "c" if len(t) == 1 else "b"))
    monkeypatch.setattr(V, "_WORDS", V._Hashes(lambda t: "w"))
    V._cells(["one two one"] * 500, 512)
    assert len(made) == len(set(made)) == 5 + 8 + 2  # o n e t w; on ne e_ _t tw wo o_ _o; one two


def test_no_texts(spark):
    assert spark.createDataFrame([], "t string").select(V.hash_cells(F.col("t"))).collect() == []
