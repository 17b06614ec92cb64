"""Uploads and questions as streams: each batch goes through all its stages and is committed as one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import cache_key, strip, token_estimate
from loreweave.functions.vectors import hash_cells
from loreweave.operators import chunking as C
from loreweave.operators import graph as G
from loreweave.sources.checkpoints import written_once

from .ledger import BatchLedger

# Percent and status of the stages of an upload.
STAGES = ((5, "正在解析文档..."), (10, "正在分析文档结构..."), (20, "正在分块..."), (50, "正在保存文档..."), (60, "正在构建向量索引..."), (80, "正在构建知识图谱..."), (100, "完成"))
FAILED = "错误: 无法解析文档"
#: Seconds that an answer can be given again.
CACHED_SECONDS = 300

_NODES = "kb_id string, id string, name string, type string, description string, category string, doc_id string"
UPLOADS = {
    "documents": "doc_id string, title string, category string, kb_id string, file_name string, content string",
    "chunks": "chunk_id string, doc_id string, chunk_index int, title string, category string, kb_id string, strategy string, text string, token_count int, cells array<struct<idx:int,weight:double>>",
    "nodes": _NODES,
    "edges": "source string, target string, type string",
    "progress": "task_id string, step int, progress int, status string, done boolean, doc_id string, strategy string, n_chunks int, n_entities int",
}
ANSWERS = {
    "events": "task_id string, n int, kind string, payload string",
    "messages": "conv_id long, turn long, role string, text string",
    "cache": "key string, answer string, n_sources int, stored_at timestamp",
}


def upload_ledger(spark, folder: str) -> BatchLedger:
    return BatchLedger(spark, folder, UPLOADS)


def answer_ledger(spark, folder: str) -> BatchLedger:
    return BatchLedger(spark, folder, ANSWERS)


def upload_stages(size: int = 500, overlap: int = 100) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """The stages of a batch of uploads (task_id, file_name, title, category, strategy, kb_id, content).

    A text is cut by its strategy ('auto' and unknown ones: recursive), its chunks
    are embedded, its words become nodes and edges of the graph, and progress tells
    each stage. A document's id is its task's. An upload of which no text could be
    read (null content) only has a progress row that says so. Uploads sent twice
    in a batch count once. A missing title is the file's name.
    """

    def stages(batch: DataFrame) -> dict[str, DataFrame]:
        once = batch.dropDuplicates(["task_id"])
        named = once.select("task_id", F.col("task_id").alias("doc_id"), F.coalesce(F.nullif("title", F.lit("")), "file_name").alias("title"), "category", "kb_id", "file_name", "content", C.strategy_of(F.col("strategy")).alias("strategy"))
        cut = None
        for name, chunker in C.CHUNKERS.items():
            own = chunker(F.col("content"), size, overlap)
            cut = F.when(F.col("strategy") == name, own) if cut is None else cut.when(F.col("strategy") == name, own)
        # All tables come from the uploads, their chunks and their words, which are made once.
        seen = written_once(named.withColumns({"_c": cut, "names": G.keywords(F.col("title"), F.col("content"))}))
        docs = seen.filter("content IS NOT NULL")
        chunks = docs.select("doc_id", "title", "category", "kb_id", "strategy", F.posexplode("_c").alias("chunk_index", "text"))
        chunks = chunks.select("*", F.concat("doc_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), token_estimate(F.col("text")).alias("token_count"), hash_cells(F.col("text")).alias("cells"))
        nodes, edges = G.build(docs.select("kb_id", "doc_id", "title", "names"))
        steps = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(p).alias("progress"), F.lit(s).alias("status"), F.lit(p == 100).alias("done")) for k, (p, s) in enumerate(STAGES)))
        failed = F.array(F.struct(F.lit(0).alias("step"), F.lit(5).alias("progress"), F.lit(FAILED).alias("status"), F.lit(True).alias("done")))
        told = seen.select("task_id", "doc_id", "strategy", F.size("_c").alias("n_chunks"), (F.size("names") + 1).alias("n_entities"), F.inline(F.when(F.col("content").isNull(), failed).otherwise(steps)))
        # What a stage finds out is known from its end on.
        from_ = lambda c, percent: F.when(F.col("progress") >= percent, F.col(c)).alias(c)
        progress = told.select("task_id", "step", "progress", "status", "done", from_("doc_id", 60), from_("strategy", 20), from_("n_chunks", 50), from_("n_entities", 100))
        return {"documents": docs, "chunks": chunks, "nodes": nodes, "edges": edges, "progress": progress}

    return stages


def answer_stages(ledger: BatchLedger, answer: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """The stages of a batch of questions (task_id, session_id, question, kb_id, ts).

    A question asked before, in the same base and behind the same last two messages,
    is answered from the cache for CACHED_SECONDS; the others are given to answer,
    from rows (task_id, question, kb_id, ...) to (task_id, answer, n_sources).
    Events tell both kinds alike. Answers that have text are remembered behind the
    session's messages, and those that were made now go into the cache. What earlier
    batches have remembered counts, within a batch the questions stand for themselves.
    A question that answer leaves out ends in an error event.
    """

    def stages(batch: DataFrame) -> dict[str, DataFrame]:
        asked = batch.dropDuplicates(["task_id"]).withColumn("_question", strip(F.coalesce("question", F.lit(""))))
        messages = ledger.read("messages").join(asked.select(F.col("session_id").alias("conv_id")).distinct(), "conv_id", "left_semi")
        newest = messages.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("_r <= 2")
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("line")))), lambda x: x["line"]), "")
        history = newest.groupBy(F.col("conv_id").alias("session_id")).agg(lines.alias("_history"), F.max("turn").alias("_last"))
        keyed = asked.join(history, "session_id", "left").withColumn("key", cache_key(F.coalesce("kb_id", F.lit("all")), F.col("_question"), {"history": F.coalesce("_history", F.lit(""))}))
        cache = ledger.read("cache").join(keyed.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max_by(F.struct("answer", "n_sources", "stored_at"), F.struct("stored_at", "answer")).alias("_kept"))
        found = keyed.join(cache, "key", "left")
        fresh = F.coalesce(F.col("ts").cast("double") - F.col("_kept.stored_at").cast("double") <= CACHED_SECONDS, F.lit(False))
        found = found.withColumn("_cached", fresh)
        made = answer(found.filter("NOT _cached").select("task_id", F.col("_question").alias("question"), "kb_id")).select("task_id", F.col("answer").alias("_made"), F.col("n_sources").alias("_n"))
        told = found.join(made, "task_id", "left").withColumns({"answer": F.when(F.col("_cached"), F.col("_kept.answer")).otherwise(F.col("_made")), "n_sources": F.when(F.col("_cached"), F.col("_kept.n_sources")).otherwise(F.col("_n")).cast("int")})
        event = lambda n, kind, payload: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), payload.alias("payload"))
        meta = F.concat(F.when(F.col("_cached"), "cached").otherwise("live"), F.lit(":"), F.col("n_sources").cast("string"))
        whole = F.array(event(0, "metadata", meta), event(1, "text", F.col("answer")), event(2, "done", F.lit("")))
        events = told.select("task_id", F.inline(F.when(F.col("answer").isNull(), F.array(event(0, "error", F.lit("no answer")))).otherwise(whole)))
        said = told.filter("answer <> ''")
        place = F.coalesce("_last", F.lit(-1)) + 2 * F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "task_id"))
        pair = F.array(*(F.struct(F.lit(k).alias("_k"), F.lit(r).alias("role"), t.alias("text")) for k, r, t in ((-1, "user", F.col("question")), (0, "assistant", F.col("answer")))))
        remembered = said.withColumn("_at", place).select(F.col("session_id").alias("conv_id"), "_at", F.inline(pair)).select("conv_id", (F.col("_at") + F.col("_k")).alias("turn"), "role", "text")
        stored = said.filter("NOT _cached").select("key", "answer", "n_sources", F.col("ts").alias("stored_at"))
        return {"events": events, "messages": remembered, "cache": stored}

    return stages
