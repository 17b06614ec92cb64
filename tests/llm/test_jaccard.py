"""Near copies by shingles, against brute force."""

import itertools
import random

from loreweave.llm import jaccard

from .test_native import docs


def _shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(ids, texts):
    """component_id of every row."""
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


def _changed(r, text, n):
    words = text.split()
    for k in r.sample(range(len(words)), n):
        words[k] = "x%d" % r.randrange(10**6)
    return " ".join(words)


def _texts(r):
    prose = lambda n: " ".join("w%03d" % r.randrange(900) for _ in range(n))
    texts = []
    for n in (3, 5, 6, 12, 60, 150, 150, 400):
        base = prose(n)
        texts += [base, base.upper()] + [_changed(r, base, k) for k in range(1, min(n, 9)) for _ in range(3)]
    passage = prose(120)
    texts += [passage + " " + prose(40) for _ in range(30)] + [passage + " " + prose(8) for _ in range(12)]
    texts += [_changed(r, passage, 1) for _ in range(25)] + [passage[: 4 * k] for k in range(60, 120, 4)]
    return [*texts, None, "", " \t", "one two", "one two"]


def test_like_brute_force(spark):
    for seed in range(2):
        r = random.Random(seed)
        texts = _texts(r)
        ids = [*r.sample(range(1000), len(texts) - 1), None]
        want = brute_force(ids, texts)
        got = jaccard.near_copies(docs(spark, texts, ids)).collect()
        assert sorted((x["doc_id"] or -1, x["component_id"]) for x in got) == sorted((i or -1, c) for i, c in zip(ids, want, strict=True))
    assert jaccard.near_copies(docs(spark, [])).collect() == []


def test_the_stage_drops_copies_of_many_differing_bits(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    texts = [t for t in _texts(r) if t and len(t.split()) > 4]
    ids = r.sample(range(1000), len(texts))
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, rows, str(tmp_path)).collect()}
    assert kept == set(brute_force(ids, texts))
