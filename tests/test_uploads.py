"""Uploads and answers: batches that are committed as one, also when they break off between tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loreweave.streaming import uploads as U
from loreweave.streaming.ledger import BatchLedger

ROWS = [
    ("t1", "a.txt", "Graph stores", "c", "fixed", "k", "Graph stores keep edges. " * 60),
    ("t2", "b.md", "", "c", "auto", "k", "One paragraph.\n\nAnother one."),
    ("t3", "c.pdf", "x", "c", "auto", "k", None),
    ("t2", "b.md", "", "c", "auto", "k", "One paragraph.\n\nAnother one."),
    ("t4", "d.txt", "empty", "c", "structure", "k", ""),
]
SCHEMA = "task_id string, file_name string, title string, category string, strategy string, kb_id string, content string"


def sent(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).parquet(str(folder))


def test_a_batch_that_breaks_off_leaves_nothing(spark, tmp_path):
    stream, whole = sent(spark, tmp_path / "in", ROWS), U.upload_stages()
    ledger = U.upload_ledger(spark, str(tmp_path / "out"))

    def broken(batch):
        return whole(batch) | {"nodes": whole(batch)["nodes"].withColumn("name", F.raise_error(F.lit("killed")).cast("string"))}

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            ledger.run(stream, broken)  # documents and chunks have been written by then
        assert ledger.batches() == [] and all(ledger.read(t).count() == 0 for t in U.UPLOADS)
    assert list((tmp_path / "out" / "chunks").iterdir())
    ledger.run(stream, whole)
    assert ledger.batches() == [0] and sorted(r["doc_id"] for r in ledger.read("documents").collect()) == ["t1", "t2", "t4"]
    chunks = sorted((r["chunk_id"], r["strategy"], r["title"]) for r in ledger.read("chunks").collect())
    assert chunks == [*((f"t1_chunk_{k}", "fixed", "Graph stores") for k in range(4)), ("t2_chunk_0", "recursive", "b.md")]
    assert ledger.read("chunks").filter("size(cells) > 0 AND token_count > 0").count() == 5
    edges = ledger.read("edges")
    assert edges.filter("source = 'doc_t1'").count() == 5 and ledger.read("nodes").filter("doc_id = 't2'").count() == 1
    # The same batch once more is done already; folders that nothing names can go.
    assert ledger.commit(0, whole(spark.createDataFrame(ROWS, SCHEMA))) is False
    assert ledger.vacuum() == 4 + 2 and ledger.read("chunks").count() == 5 and ledger.vacuum() == 0
    sent(spark, tmp_path / "in", [("t9", "z.txt", "later", "c", "semantic", "k", "A sentence.")])
    ledger.run(stream, whole)
    assert ledger.batches() == [0, 1] and ledger.read("documents").count() == 4


def test_progress_of_uploads(spark, tmp_path):
    ledger = U.upload_ledger(spark, str(tmp_path / "out"))
    assert ledger.commit(0, U.upload_stages()(spark.createDataFrame(ROWS, SCHEMA)))
    told = {t: [r.asDict() for r in ledger.read("progress").filter(F.col("task_id") == t).orderBy("step").collect()] for t in ("t1", "t3", "t4")}
    assert [r["progress"] for r in told["t1"]] == [5, 10, 20, 50, 60, 80, 100] and [r["done"] for r in told["t1"]] == [False] * 6 + [True]
    assert [r["n_chunks"] for r in told["t1"]] == [None] * 3 + [4] * 4 and [r["strategy"] for r in told["t1"]][:3] == [None, None, "fixed"]
    assert told["t1"][-1]["n_entities"] == 5 and told["t1"][-1]["doc_id"] == "t1" and told["t1"][-1]["status"] == "完成"
    assert len(told["t3"]) == 1 and told["t3"][0]["done"] and told["t3"][0]["status"].startswith("错误") and told["t3"][0]["n_chunks"] is None
    assert told["t4"][-1]["n_chunks"] == 0
    with pytest.raises(ValueError):
        ledger.commit(1, {})


QUESTIONS = "task_id string, session_id long, question string, kb_id string, ts timestamp"
ANSWERED = lambda q: q.filter("question <> 'lost'").select("task_id", F.concat(F.lit("re: "), "question").alias("answer"), F.lit(2).alias("n_sources"))


def test_answers_are_given_again_from_the_cache(spark, tmp_path):
    ledger, at = U.answer_ledger(spark, str(tmp_path / "out")), datetime(2024, 1, 1)
    batches = [
        [("a", 1, " q ", "k", at), ("b", 2, "lost", "k", at)],
        [("c", 3, "q", "k", at + timedelta(seconds=300)), ("d", 4, "q", None, at), ("e", 1, "q", "k", at), ("f", 5, "q", "k", at + timedelta(seconds=301))],
        [("g", 1, "q", "k", at)],
        [("h", 1, "q", "k", at)],
    ]
    for rows in batches:
        stream = sent(spark, tmp_path / "in", rows, QUESTIONS)
        ledger.run(stream, U.answer_stages(ledger, ANSWERED))
    events = {(r["task_id"], r["n"]): (r["kind"], r["payload"]) for r in ledger.read("events").collect()}
    kinds = {t: events[t, 0] for t in "abcdefgh"}
    live, cached = ("metadata", "live:2"), ("metadata", "cached:2")
    # Another base, a time that is up, and another history are other questions; g and h stand behind the same two messages as each other.
    assert kinds == {"a": live, "b": ("error", "no answer"), "c": cached, "d": live, "e": live, "f": live, "g": live, "h": cached}
    assert events["c", 1] == ("text", "re: q") and events["c", 2] == ("done", "") and ("b", 1) not in events
    memory = [(r["turn"], r["role"], r["text"]) for r in ledger.read("messages").filter("conv_id = 1").orderBy("turn").collect()]
    assert memory == [(k, *x) for k, x in enumerate([("user", " q "), ("assistant", "re: q")] + [("user", "q"), ("assistant", "re: q")] * 3)]


def test_an_entry_is_seen_whole(spark, tmp_path):
    ledger = BatchLedger(spark, str(tmp_path / "l"), {"x": "a int", "y": "b int"})
    one = lambda c: spark.range(1).select(F.col("id").cast("int").alias(c))
    assert ledger.read("x").count() == 0 and ledger.commit(7, {"x": one("a"), "y": one("b").limit(0)})
    assert ledger.read("x").count() == 1 and ledger.read("y").columns == ["b"] and ledger.read("y").count() == 0
