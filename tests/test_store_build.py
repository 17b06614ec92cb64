"""How the kept index is built: without a shuffle, its lists where their cells are read."""

from itertools import count

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from loreweave.functions.vectors import hash_cells
from loreweave.operators import chunking as C
from loreweave.operators import store as S


def _shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    n, stages = 0, context.statusStore()
    for k in count():
        try:
            n += stages.lastStageAttempt(k).shuffleWriteBytes()
        except Py4JJavaError:  # no such stage yet
            return n


def test_nothing_is_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 2)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.col("id").cast("string"), 90)).alias("content"))
    index = S.SearchIndex(spark, str(tmp_path / "i"))
    before = _shuffled(spark)
    index.build(docs, C.fixed(F.col("content"), 100, 20))
    assert _shuffled(spark) == before
    lists = spark.read.parquet(str(tmp_path / "i" / "postings"))
    assert lists.filter("size(entries) > 4 OR high < low").isEmpty() and not lists.filter("size(entries) > 1").isEmpty()
    # Every cell of every chunk is in one list.
    made = index.chunks().select("doc_id", "chunk_index", F.inline(hash_cells(F.col("text"))))
    assert sorted(map(tuple, index.cells().collect())) == sorted(map(tuple, made.collect()))
