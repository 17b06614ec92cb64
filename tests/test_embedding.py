"""Embedding by a model that fails on some texts."""

import pytest
from pyspark.sql import functions as F

from loreweave.functions.vectors import hash_cells
from loreweave.operators import embedding as M
from loreweave.operators.answers import EMBEDDERS


def _flaky():
    """A model that fails for a batch with a bad text, for that text alone too, and that returns short and odd vectors."""

    class Flaky:
        dimension = 3
        calls = 0

        def encode(self, texts):
            type(self).calls += 1
            assert len(texts) <= 4
            if any("bad" in t for t in texts):
                raise RuntimeError("out of service")
            if "fewer" in texts:
                return []
            return [[1.0] if t == "short" else [float("nan")] * 3 if t == "odd" else [len(t), 0, 1] for t in texts]

        def encode_query(self, texts):
            return [[0, 0, v[0]] for v in self.encode(texts)]

    return Flaky()


def _absent():
    raise OSError("no weights")


@pytest.fixture
def providers(monkeypatch):
    monkeypatch.setitem(EMBEDDERS, "flaky", _flaky)
    monkeypatch.setitem(EMBEDDERS, "absent", _absent)


TEXTS = ["a", "bb", "bad one", "short", "odd", None, "", "fewer"] + [f"text {k}" for k in range(40)]


def rows(spark):
    return spark.createDataFrame([(k if k else None, t, 1) for k, t in enumerate(TEXTS)], "k long, t string, cells int").repartition(3)


def test_what_a_model_cannot_do_is_hashed(spark, providers):
    found = M.embedded(rows(spark), "k", "t", "flaky", batch=4)
    got = {r["k"]: r for r in found.collect()}
    assert len(got) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        r = got[k or None]
        if text in ("bad one", "short", "odd", "fewer"):
            assert r["backend"] == "hash" and r["embedding"] is None and [tuple(c) for c in r["cells"]] == [tuple(c) for c in spark.range(1).select(hash_cells(F.lit(text))).first()[0]]
        else:
            assert r["backend"] == "flaky" and r["embedding"] == [len(text or ""), 0, 1] and r["cells"] is None and r["error"] is None
    assert got[2]["error"] == "RuntimeError: out of service" and got[3]["error"] == "1 numbers instead of 3" and got[4]["error"] == "a number that is none" and got[7]["error"].startswith("ValueError")
    assert {(r["backend"], r["n"]) for r in M.embedding_report(found).filter("error IS NULL").collect()} == {("flaky", len(TEXTS) - 4)}
    assert M.embedded(rows(spark).filter("k = 1"), "k", "t", "flaky", query=True).first()["embedding"] == [0, 0, 2]


def test_models_that_are_not_there(spark, providers):
    found = M.embedded(rows(spark), "k", "t", "absent").collect()
    assert {(r["backend"], r["error"]) for r in found} == {("hash", "OSError: no weights")} and len(found) == len(TEXTS)
    assert M.embedded(rows(spark).limit(0), "k", "t", "absent").collect() == []
    assert {r["backend"] for r in M.embedded(rows(spark), "k", "t").collect()} == {"hash"}
    with pytest.raises(ValueError):
        M.embedded(rows(spark), "k", "t", "unknown")
    assert spark.range(1).select(M.with_query_prefix(F.lit("q"))).first()[0].endswith("q")
