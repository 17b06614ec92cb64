"""Migration of the driver's tables, written as JSON entries of the seven stores; some entries are wrong on purpose."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators.migrations import ENTITIES, Migration
from loreweave.sources.checkpoints import shared_folder
from loreweave.sources.tables import table

from .registry import query


def _stores(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """key, entry of each entity. What is null is left out of an entry."""
    t = lambda name: table(spark, sf_dir, name)
    entry = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("entry")
    key = lambda c: F.col(c).cast("string").alias("key")
    c = F.col
    return {
        "users": t("customer").select(key("c_custkey"), entry(username=c("c_name"), password_hash=F.when(c("c_custkey") % 20 != 0, F.md5("c_name")), roles=F.array("c_mktsegment"))),
        "categories": t("documents").select("source").distinct().select(key("source"), entry(strategy=F.lit("fixed"), chunk_size=F.when(c("source").endswith("1"), "many").otherwise("300"))),
        "references": t("part").select(key("p_partkey"), entry(title=c("p_name"), authors=F.array("p_brand"), year=F.when(c("p_partkey") % 10 == 0, F.lit("unknown")).otherwise(c("p_size").cast("string")), type=c("p_type"))),
        "documents": t("documents").select(key("doc_id"), entry(title=F.concat(F.lit("doc_"), c("doc_id").cast("string")), content=c("text"), category=c("source"), knowledge_base_id=F.when(c("lang") != "en", c("lang")), n_chars=c("n_chars"))),
        "document_versions": t("conversations").select(F.concat_ws("-v", c("conv_id").cast("string"), c("turn").cast("string")).alias("key"), entry(doc_id=c("conv_id"), version=c("turn"), content=c("text"), changed_by=c("role"))),
        "op_log": t("events").select(key("event_id"), entry(time=F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), operator=c("user_id").cast("string"), action=c("event_type"), migrated_count=F.when(c("event_id") % 100 == 0, "none").otherwise("1"), value=c("value"))),
        "chat_stats": t("conversations").agg(F.count_distinct("conv_id").alias("s"), F.count(F.lit(1)).alias("m")).select(F.lit("1").alias("key"), entry(total_sessions=c("s"), total_messages=c("m"))),
    }


def _migrated(spark: SparkSession, sf_dir: str, only: list[str], runs: int = 1) -> tuple[Migration, list[tuple]]:
    made, stores = Migration(spark, f"{shared_folder(spark)}/migrated-{uuid.uuid4().hex}"), _stores(spark, sf_dir)
    return made, [(run, name, *made.run(ENTITIES[name], stores[name])) for run in range(1, runs + 1) for name in only]


_READ = """
WITH r AS (
    SELECT 'users' AS entity, count(*) AS n, count(*) FILTER (c_custkey % 20 = 0) AS bad FROM customer
    UNION ALL SELECT 'categories', count(DISTINCT source), count(DISTINCT source) FILTER (source LIKE '%1') FROM documents
    UNION ALL SELECT 'references', count(*), count(*) FILTER (p_partkey % 10 = 0) FROM part
    UNION ALL SELECT 'documents', count(*), 0 FROM documents
    UNION ALL SELECT 'document_versions', count(*), 0 FROM conversations
    UNION ALL SELECT 'op_log', count(*), count(*) FILTER (event_id % 100 = 0) FROM events
    UNION ALL SELECT 'chat_stats', 1, 0
)"""


@query(f"""{_READ}
SELECT CAST(run AS INTEGER) AS run, entity, CASE run WHEN 1 THEN n ELSE 0 END AS n_read, CASE run WHEN 1 THEN n - bad ELSE 0 END AS n_added, CASE run WHEN 1 THEN bad ELSE 0 END AS n_rejected FROM r, (VALUES (1), (2)) t(run)""")
def migration_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities twice; the second run finds its stores in the ledger."""
    return spark.createDataFrame(_migrated(spark, sf_dir, list(ENTITIES), 2)[1], "run int, entity string, n_read long, n_added long, n_rejected long")


@query("""
SELECT 'users' AS entity, CAST(c_custkey AS VARCHAR) AS key, 'no password_hash' AS problem FROM customer WHERE c_custkey % 20 = 0
UNION ALL SELECT DISTINCT 'categories', source, 'chunk_size is no int' FROM documents WHERE source LIKE '%1'
UNION ALL SELECT 'references', CAST(p_partkey AS VARCHAR), 'year is no int' FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT 'op_log', CAST(event_id AS VARCHAR), 'migrated_count is no int' FROM events WHERE event_id % 100 = 0""")
def migration_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = _migrated(spark, sf_dir, ["users", "categories", "references", "op_log"])
    return made.table("rejects", "").read().select("entity", "key", "problem")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'doc_' || doc_id AS title, text AS content, CASE WHEN lang <> 'en' THEN lang ELSE 'default' END AS kb_id, source AS category, CAST(n_chars AS VARCHAR) AS n_chars, '' AS file_name FROM documents")
def migrated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' table after the migration; a field without a column of its own is kept beside them."""
    made, _ = _migrated(spark, sf_dir, ["documents"])
    return made.table("documents", "").read().select("id", "title", "content", "kb_id", "category", F.col("extra")["n_chars"].alias("n_chars"), "file_name")
