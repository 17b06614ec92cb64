"""Counts and summaries over documents, chunks, messages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import stats
from loreweave.sources import files
from loreweave.sources.tables import audit, documents, messages, table

from .chunks import FIXED_SQL, base_chunks
from .registry import query

_CHUNKS = f"WITH c AS (SELECT f.*, source AS category FROM ({FIXED_SQL}) f JOIN documents d USING (doc_id))"


@query(f"{_CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, count(DISTINCT category) AS n_categories FROM c")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.collection_stats(base_chunks(spark, sf_dir))


@query(f"{_CHUNKS} SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 10")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top(base_chunks(spark, sf_dir), "doc_id", 10)


@query(f"{_CHUNKS} SELECT category, count(*) AS n FROM c GROUP BY category")
def chunk_stats_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top(base_chunks(spark, sf_dir), "category")


@query(f"{_CHUNKS} SELECT d.doc_id, substr(d.text, 1, 200) AS preview, count(c.doc_id) AS n_chunks FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id, d.text")
def docs_with_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.substring("content", 1, 200).alias("preview"))
    return stats.chunk_counts(docs, base_chunks(spark, sf_dir))


@query(f"{_CHUNKS}, n AS (SELECT doc_id, count(*) AS k FROM c GROUP BY doc_id) SELECT source AS category, count(*) AS n_docs, CAST(sum(coalesce(k, 0)) AS BIGINT) AS n_chunks FROM documents LEFT JOIN n USING (doc_id) GROUP BY source")
def kb_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.category_totals(documents(spark, sf_dir), base_chunks(spark, sf_dir))


@query(r"SELECT source AS category, count(*) OVER (PARTITION BY source) AS n_docs, doc_id, 'doc_' || doc_id AS title, CAST(length(t) AS INTEGER) AS n_chars, regexp_replace(substr(t, 1, 500), '\s+', ' ', 'g') AS preview FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)")
def meta_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.snapshot(documents(spark, sf_dir))


@query("SELECT source AS category, count(*) OVER (PARTITION BY source) AS n_docs, doc_id, 'doc_' || doc_id AS title FROM documents")
def meta_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.listing(documents(spark, sf_dir))


@query("SELECT 'action' AS kind, event_type AS name, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10) UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, CAST(user_id AS VARCHAR) LIMIT 10) UNION ALL SELECT 'denied', 'view', count(*) FROM events WHERE event_type = 'view' OR value < 10")
def audit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access counts as denied by one action or by a record's result."""
    return stats.audit_stats(audit(spark, sf_dir).withColumn("result", F.when(F.col("value") < 10, "denied").otherwise("ok")), denied="view")


@query("SELECT user_id, CAST(greatest(0, count(*) - 30) AS BIGINT) AS n FROM events GROUP BY user_id")
def tag_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that thirty removals have lessened, not below 0."""
    counts = audit(spark, sf_dir).groupBy("username").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(F.col("username").cast("long").alias("user_id"), stats.counter(F.col("_n"), F.lit(-30)).alias("n"))


@query("SELECT count(*) FILTER (value > 50) AS n_kept, count(*) AS n, round(count(*) FILTER (value > 50) / count(*), 4) AS ratio FROM events")
def status_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.share(audit(spark, sf_dir), F.col("value") > 50)


@query("SELECT DISTINCT lang AS kb_id, source AS category FROM documents")
def base_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories that each base holds."""
    return documents(spark, sf_dir).select("kb_id", "category").distinct()


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 50")
def audit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.audit_filter(audit(spark, sf_dir), action="click", n=50).select("event_id", F.col("username").cast("long").alias("user_id"), "value")


@query("SELECT event_id, event_type AS action FROM events ORDER BY ts, event_id LIMIT 500")
def oldest_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.oldest_operations(audit(spark, sf_dir)).select("event_id", "action")


@query("SELECT event_type AS action, count(*) FILTER (value > 0) AS n_ok, count(*) FILTER (NOT value > 0) AS n_failed, CAST(sum(k) AS BIGINT) AS total FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def operation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit(spark, sf_dir).select("action", (F.col("value") > 0).alias("ok"), F.col("k").alias("amount"))
    return stats.operation_summary(log)


@query(f"{_CHUNKS} SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(DISTINCT source) FROM documents) AS n_categories, (SELECT count(*) FROM c) AS n_chunks, count(DISTINCT conv_id) AS n_sessions, count(*) AS n_messages, round(count(*) / greatest(count(DISTINCT conv_id), 1), 1) AS per_session FROM conversations")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dashboard(documents(spark, sf_dir), base_chunks(spark, sf_dir), messages(spark, sf_dir))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_quantity < 40 GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity < 40")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
