"""The quality classifier: parts against plain versions, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pandas as pd

from loreweave.llm import classifier

SCHEMA = "doc_id long, text string, quality int, y int, fold int, score int, n_words int, chars int"


def texts(rng, n):
    words = "the of and river stone house walking garden to letter in a morning that".split()
    for k in range(n):
        good = " ".join(rng.choices(words, k=rng.randrange(20, 200))).capitalize() + ".\n" + " ".join(rng.choices(words, k=20)) + "."
        bad = [lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "*** "), lambda t: " ".join(w + f" {w}" * 6 for w in t.split()[:9]), lambda t: t.replace(" ", " | ")]
        quality = int(rng.random() < 0.7)
        yield k, good if quality else rng.choice(bad)(good), quality


def rows(spark, docs):
    return spark.createDataFrame([(i, t, *[9] * 6) for i, t in docs], SCHEMA)


def test_held_out_documents(spark):
    made = list(texts(random.Random(1), 900))
    odd = [(None, "no key at all"), (5000, None), (5001, ""), (5002, "the stone " * 40_000), (7, made[7][1])]
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in made] + [(None, 0, 0), (3, None, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    found = classifier.quality_scores(rows(spark, [(i, t) for i, t, _ in made] + odd), labels).toPandas()
    assert list(found.columns) == ["doc_id", "held_out", "score", "predicted"] and len(found) == len(made) + len(odd)
    assert found["score"].between(0, 1).all() and ((found["score"] >= 0.3) == (found["predicted"] == 1)).all()
    known = found[found["doc_id"].notna()]
    assert [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in known["doc_id"]] == known["held_out"].tolist()
    assert found[found["doc_id"].isna()]["held_out"].all() and found[found["doc_id"] == 7]["score"].nunique() == 1
    test = known[known["held_out"]].merge(pd.DataFrame(made, columns=["doc_id", "text", "quality"]), on="doc_id")
    assert len(test) > 100 and (test["predicted"] == test["quality"]).mean() > 0.98
    good, bad = test[test["quality"] == 1]["score"].to_numpy(), test[test["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad).mean() > 0.99


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r["score"], r["predicted"]) for r in classifier.quality_scores(rows(spark, [(1, "a"), (2, None)]), none).collect()] == [(0.5, 1)] * 2
    assert classifier.quality_scores(rows(spark, []), none).collect() == []
    same = classifier.quality_scores(rows(spark, [(k, "one text") for k in range(20)]), spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")).collect()
    assert min(r["score"] for r in same) > 0.9


def test_equations_are_those_of_all_rows(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.normal(size=(400, 3)), columns=list("abc")).assign(y=rng.integers(0, 2, 400).astype(float), fold=rng.integers(0, classifier.FOLDS, 400).astype("int32"))
    learnt = spark.createDataFrame(frame).repartition(7)
    features, n = classifier.fit_features(learnt, list("abc"))
    assert n == 400
    sums, x = classifier.normal_equations(learnt, features), features(frame)
    for fold in range(classifier.FOLDS):
        own = frame["fold"] == fold
        assert np.allclose(sums[fold], x[own].T @ np.c_[x[own], frame["y"][own]])
    # The cosines' products are near the Gaussian kernel of the standardised rows.
    z = ((frame[list("abc")] - features.mean) / features.scale).to_numpy()
    kernel = np.exp(-((z[:, None] - z) ** 2).sum(-1) / (2 * classifier.WIDTH**2))
    assert np.abs(x[:, :-1] @ x[:, :-1].T - kernel).mean() < 0.06


def test_isotonic_is_the_least_squares_rise():
    rng = np.random.default_rng(2)
    at, n = np.arange(40.0), rng.integers(1, 9, 40)
    ones = np.array([rng.binomial(k, min(1, x / 40)) for k, x in zip(n, at, strict=True)])
    first, last, shares = classifier.isotonic(at, n, ones)
    assert (np.diff(shares) > 0).all() and (first <= last).all() and (first[1:] == last[:-1] + 1).all()
    y, best = ones / n, []
    for i in range(40):  # max over starts of the min over ends of means
        mean = lambda a, b: ones[a : b + 1].sum() / n[a : b + 1].sum()
        best.append(max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)))
    assert np.allclose(sorted(set(np.round(best, 9))), np.round(shares, 9)) and y.size == 40
