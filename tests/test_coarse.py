"""The approximate index: recall against the exact search, and that nothing is left out of it."""

import numpy as np
import pytest

from loreweave.operators import coarse
from loreweave.operators import retrieval as R


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    rows = [(f"v{k:05d}", (centres[k % 30] + 0.6 * rng.normal(size=24)).tolist()) for k in range(3000)]
    rows += [(f"s{k}", rng.normal(size=5).tolist()) for k in range(40)] + [("zero", [0.0] * 24), ("void", []), ("null", None), (None, [1.0] * 24)]
    return spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(4)


def test_recall_and_scores(spark, vectors, tmp_path):
    index = coarse.CoarseIndex(spark, str(tmp_path / "i")).build(vectors)
    assert spark.read.parquet(str(tmp_path / "i" / "codes")).count() == 3041  # every row with an id and numbers
    queries = vectors.filter("vec_id LIKE 'v%00' OR vec_id LIKE 's%'").selectExpr("vec_id AS query_id", "embedding AS query").unionByName(spark.createDataFrame([("other", [1.0] * 7), ("void", [])], "query_id string, query array<double>"))
    exact = R.vector_top_k(queries, vectors, 10).cache()
    found = index.near(queries, 10).cache()
    assert coarse.recall(found, exact).first()["recall"] >= 0.9
    assert {r["query_id"] for r in found.select("query_id").distinct().collect()} == {r["query_id"] for r in exact.select("query_id").distinct().collect()}
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in exact.collect()}
    assert all(abs(scores[key] - r["score"]) < 2e-6 for r in found.collect() if (key := (r["query_id"], r["vec_id"])) in scores)
    assert coarse.recall(index.near(queries, 10, probes=1), exact).first()["recall"] <= coarse.recall(found, exact).first()["recall"] <= coarse.recall(index.near(queries, 10, probes=2000), exact).first()["recall"]
    assert coarse.recall(index.near(queries, 10, probes=2000), exact).first()["recall"] >= 0.99
    assert index.near(queries.filter("query_id = 'other'"), 3).collect() == [] and index.near(queries.limit(0), 3).collect() == []


def test_driver_vectors(spark):
    """The table of the tests' driver, its stated queries: ids divisible by 100."""
    import os

    from loreweave.plans import hybrid

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    found = hybrid.vector_topk_coarse(spark, "/root/testdata/sf0.01")
    assert coarse.recall(found, hybrid.vector_topk(spark, "/root/testdata/sf0.01")).first()["recall"] >= 0.9
