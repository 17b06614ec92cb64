"""Uploads and questions made of the driver's tables, run as streams whose batches are committed as one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.sources.checkpoints import shared_folder
from loreweave.sources.tables import table
from loreweave.streaming import uploads as U
from loreweave.streaming.ledger import BatchLedger

from .chunks import FIXED_SQL
from .graphs import GRAPH_SQL
from .registry import query


def _uploaded(spark: SparkSession, sf_dir: str) -> BatchLedger:
    """Every document as an upload of its own, of which French ones can't be read."""
    rows = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/[d]ocuments.parquet")
    key = F.col("doc_id").cast("string")
    sent = rows.select(
        key.alias("task_id"),
        F.concat(F.lit("doc_"), key).alias("file_name"),
        F.lit("").alias("title"),
        F.col("source").alias("category"),
        F.lit("fixed").alias("strategy"),
        F.col("lang").alias("kb_id"),
        F.when(~F.col("lang").eqNullSafe("fr"), F.col("text")).alias("content"),
    )
    ledger = U.upload_ledger(spark, f"{shared_folder(spark)}/uploads-{uuid.uuid4().hex}")
    ledger.run(sent, U.upload_stages())
    return ledger


_STEPS = ", ".join(f"({k}, {p}, '{s}')" for k, (p, s) in enumerate(U.STAGES))


@query(f"""
WITH c AS (SELECT doc_id, count(*) AS n FROM ({FIXED_SQL}) GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS task_id, CAST(k AS INTEGER) AS step, CAST(p AS INTEGER) AS progress, s AS status, p = 100 AS done, CASE WHEN p >= 50 THEN CAST(coalesce(c.n, 0) AS INTEGER) END AS n_chunks
FROM documents d LEFT JOIN c USING (doc_id), (VALUES {_STEPS}) t(k, p, s) WHERE lang IS DISTINCT FROM 'fr'
UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, 5, '{U.FAILED}', true, NULL FROM documents WHERE lang = 'fr'""")
def upload_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uploaded(spark, sf_dir).read("progress").select("task_id", "step", "progress", "status", "done", "n_chunks")


@query(f"""
WITH {GRAPH_SQL}, read AS (SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'fr'),
e AS (SELECT edges.* FROM edges JOIN read ON source = 'doc_' || doc_id)
SELECT 'documents' AS sink, count(*) AS n FROM read UNION ALL SELECT 'chunks', count(*) FROM ({FIXED_SQL}) SEMI JOIN read USING (doc_id)
UNION ALL SELECT 'nodes', (SELECT count(*) FROM read) + (SELECT count(DISTINCT target) FROM e) UNION ALL SELECT 'edges', count(*) FROM e""")
def upload_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables that the batches have committed; an entity that several batches name is one node."""
    ledger = _uploaded(spark, sf_dir)
    rows = {"documents": ledger.read("documents"), "chunks": ledger.read("chunks"), "nodes": ledger.read("nodes").select("id").distinct(), "edges": ledger.read("edges")}
    found = None
    for name, df in rows.items():
        one = df.agg(F.lit(name).alias("sink"), F.count(F.lit(1)).alias("n"))
        found = one if found is None else found.unionByName(one)
    return found


#: Added to the session of a question that is asked again, and its seconds after the first batch for each session.
AGAIN, LATER = 1_000_000_000, 4


@query(f"""
WITH q AS (SELECT conv_id, trim(text) AS t, length(text) % 3 AS n FROM conversations WHERE turn = 0),
a AS (SELECT conv_id, t, n, 'live' AS how FROM q UNION ALL SELECT conv_id + {AGAIN}, t, n, CASE WHEN {LATER} * conv_id <= 300 THEN 'cached' ELSE 'live' END FROM q)
SELECT CAST(conv_id AS VARCHAR) AS task_id, CAST(k AS INTEGER) AS n, kind, CASE k WHEN 0 THEN how || ':' || n WHEN 1 THEN 're: ' || t ELSE '' END AS payload FROM a, (VALUES (0, 'metadata'), (1, 'text'), (2, 'done')) t(k, kind)""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first question of every conversation, and later the same of another session: the events of both batches."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    asked = table(spark, sf_dir, "conversations").filter("turn = 0")
    folder = f"{shared_folder(spark)}/questions-{uuid.uuid4().hex}"
    ledger = U.answer_ledger(spark, f"{folder}/out")
    reply = lambda q: q.select("task_id", F.concat(F.lit("re: "), "question").alias("answer"), (F.length("question") % 3).alias("n_sources"))
    for again in (0, 1):
        session = F.col("conv_id") + again * AGAIN
        at = F.timestamp_seconds(F.unix_timestamp(start) + again * LATER * F.col("conv_id"))
        # The question itself names its base, so that sessions of equal questions don't answer each other.
        rows = asked.select(session.cast("string").alias("task_id"), session.alias("session_id"), F.col("text").alias("question"), F.col("conv_id").cast("string").alias("kb_id"), at.alias("ts"))
        rows.write.mode("append").parquet(f"{folder}/in")
        ledger.run(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), U.answer_stages(ledger, reply))
    return ledger.read("events")
