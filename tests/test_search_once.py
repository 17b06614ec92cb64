"""Windows are cut in one pass over a text, and a text is lowered once."""

from pyspark.sql import functions as F

from loreweave.operators import chunking as C
from loreweave.operators import retrieval as R


def test_windows_are_cut_in_one_pass_and_as_by_place(spark, monkeypatch):
    texts = ["", "a", " x" * 700, "\n\r \x85 " * 300, "😀é漢" * 400, "😀 " * 999, "y" * 500, "y" * 501, "z" * 900 + " " * 600, None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    cut = lambda: docs.select("k", C.fixed(F.col("t")).alias("a"), C.fixed(F.col("t"), 7, 5).alias("b"), C.naive(F.col("t"), 30, 29).alias("c"), C.general(F.col("t")).alias("d"))
    assert "substr(" not in docs.select(C._windows(F.col("t"), F.lit(3), 400, 500))._jdf.queryExecution().analyzed().toString()
    found = cut().collect()
    monkeypatch.setattr(C, "ONE_PASS", 0)
    assert found == cut().collect()


def test_a_text_is_lowered_once(spark):
    docs = spark.createDataFrame([(1, "The and THE"), (2, None), (3, "x" * 400 + " thinking"), (4, "ÉÀ the"), (5, "none")], "doc_id long, content string")
    best = R.keyword_search(docs, "worthless and the, thinking", 9)
    assert best._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [tuple(r)[:4] for r in best.collect()] == [(1, 2, 3, 0.79), (3, 1, 1, 0.58), (4, 1, 1, 0.58)]
    assert best.collect()[1]["snippet"] == "x" * 299 + " thinking"
