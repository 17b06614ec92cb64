"""Source divergence against counts by plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from loreweave.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, value int, rank int"


def brute(docs, least, top):
    lower = lambda t: "".join(c.lower() if c < "\x80" else c for c in t)
    counts, df, out = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        terms = re.findall(r"[A-Za-z\x80-\U0010ffff]+", lower(text or ""))
        counts[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    p = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    for (lang, source), own in counts.items():
        kept = [t for t, k in df[lang].items() if k >= least]
        total = lambda c: sum(c[t] for t in kept)
        whole = sum((c for (k, _), c in counts.items() if k == lang), Counter())
        at = lambda c: {t: p(c[t], total(c), len(kept)) for t in kept}
        mine, all_ = at(own), at(whole)
        terms = [(t, mine[t] - all_[t]) for t in kept if own[t] and mine[t] > all_[t]]
        pairs = [(s, sum(abs(mine[t] - q) for t, q in at(c).items())) for (k, s), c in counts.items() if k == lang and s != source]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.add((lang, source, part, item, value, rank))
    return out


def rows(spark, docs):
    return spark.createDataFrame([(k, *d, "x", 1, 1, 1) for k, d in enumerate(docs)], SCHEMA)


def got(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


def test_against_counts(spark, monkeypatch):
    rng = random.Random(3)
    words = ["the", "The", "straße", "É", "é", "ÉTÉ", "x1y", "a-b", "漢字", "w"] + [f"rare{chr(97 + i)}" for i in range(20)]
    docs = [(" ".join(rng.choices(words, k=rng.randrange(40))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None, "B"])) for _ in range(120)]
    docs += [("the", "xx", "alone"), ("", "yy", "a"), (None, "yy", "b"), ("term ending", "en", "a"), ("ly begun", "en", "a"), ("the " * 30_000 + "zebra", "en", "c")] + [("equal rows", "en", "a")] * 5
    for held, part in ((1 << 20, 1 << 22), (8, 64)):
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "PART", part)
        found = got(divergence.source_divergence(rows(spark, docs), least=4, top=3))
        assert len(found) == len(set(found)) and set(found) == brute(docs, 4, 3)


def test_no_kept_terms_and_no_rows(spark):
    assert sorted(got(divergence.source_divergence(rows(spark, [("a b", "en", "s"), ("c", "en", "t"), ("d", "en", "r")])))) == [
        ("en", "r", "pair", "s", 0, 1),
        ("en", "r", "pair", "t", 0, 2),
        ("en", "s", "pair", "r", 0, 1),
        ("en", "s", "pair", "t", 0, 2),
        ("en", "t", "pair", "r", 0, 1),
        ("en", "t", "pair", "s", 0, 2),
    ]
    assert got(divergence.source_divergence(rows(spark, []))) == []


def test_terms_of_a_slice_and_places_in_the_filter():
    texts = pa.array([b"zz", b"", b"Ab\x00c", "é1É".encode(), b"", b"q"], pa.large_binary())[1:]
    doc, words = divergence.terms_in(texts)
    assert list(zip(doc.tolist(), words.to_pylist(), strict=True)) == [(1, "ab"), (1, "c"), (2, "é"), (2, "É"), (4, "q")]
    terms = pa.array([f"t{i}" for i in range(5000)] + ["long" * 5000], pa.large_string())
    places = divergence.buckets("en", terms)
    assert places.min() >= 0 and places.max() < divergence.FILTER_BITS and len(np.unique(places)) > 4990
    assert (places[7:9] == divergence.buckets("en", terms[7:9])).all() and (places != divergence.buckets("de", terms)).sum() > 4990
