"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.text import strip


def collection_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, documents, categories."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct(F.coalesce("category", F.lit("default"))).alias("n_categories"))


def top(rows: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """key and its count, most frequent first."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)
    return counted.limit(n) if n else counted


def chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """docs with n_chunks."""
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return docs.join(counts, "doc_id", "left").withColumn("n_chunks", F.coalesce("_n", F.lit(0))).drop("_n")


def category_totals(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    counted = chunk_counts(docs, chunks)
    return counted.groupBy("category").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chunks").alias("n_chunks")).orderBy("category")


def snapshot(docs: DataFrame, width: int = 500) -> DataFrame:
    """category, n_docs, doc_id, title, n_chars, preview: every document, with the size of its category.

    A document is a row, so no category is one value or one task; order by n_docs,
    category and doc_id to list them. preview: the first characters of the trimmed
    text, then with white space in one line.
    """
    text = strip(F.coalesce("content", F.lit("")))
    sizes = docs.groupBy("category").agg(F.count(F.lit(1)).alias("n_docs"))
    preview = F.regexp_replace(F.substring(text, 1, width), r"(?U)\s+", " ")
    rows = docs.select("category", "doc_id", "title", F.length(text).alias("n_chars"), preview.alias("preview"))
    return rows.join(sizes, "category").select("category", "n_docs", "doc_id", "title", "n_chars", "preview")


def listing(docs: DataFrame) -> DataFrame:
    """The snapshot without previews."""
    return snapshot(docs.withColumn("content", F.lit(""))).drop("preview", "n_chars")


def counter(before: Column, change: Column) -> Column:
    """A count after a change; it doesn't fall below 0."""
    return F.greatest(F.lit(0), F.coalesce(before, F.lit(0)) + change)


def share(rows: DataFrame, keep: Column) -> DataFrame:
    """n_kept, n and ratio of the rows for which keep holds; no rows: 0."""
    return rows.agg(F.count_if(keep).alias("n_kept"), F.count(F.lit(1)).alias("n")).withColumn("ratio", F.round(F.col("n_kept") / F.greatest("n", F.lit(1)), 4))


def audit_stats(audit: DataFrame, n: int = 10, denied: str = "denied") -> DataFrame:
    """kind ('action', 'user', 'denied'), name, n: the n most frequent actions and users, and how often access was denied, by action or by result."""
    actions = top(audit, "action", n).select(F.lit("action").alias("kind"), F.col("action").alias("name"), "n")
    users = top(audit.filter(F.coalesce("username", F.lit("")) != ""), "username", n).select(F.lit("user").alias("kind"), F.col("username").alias("name"), "n")
    by_result = F.coalesce(F.col("result") == "denied", F.lit(False)) if "result" in audit.columns else F.lit(False)
    refused = audit.agg(F.count_if((F.col("action") == denied) | by_result).alias("n")).select(F.lit("denied").alias("kind"), F.lit(denied).alias("name"), "n")
    return actions.unionByName(users).unionByName(refused)


def audit_filter(audit: DataFrame, action: str | None = None, username: str | None = None, since=None, until=None, n: int = 100) -> DataFrame:
    """The newest n records that match."""
    for name, value in (("action", action), ("username", username)):
        if value is not None:
            audit = audit.filter(F.col(name) == value)
    if since is not None:
        audit = audit.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        audit = audit.filter(F.col("ts") <= F.lit(until).cast("timestamp"))
    return audit.orderBy(F.desc("ts"), "event_id").limit(n)


def dashboard(docs: DataFrame, chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """One row of totals and the messages to a session."""
    d = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("category").alias("n_categories"))
    c = chunks.agg(F.count(F.lit(1)).alias("n_chunks"))
    m = messages.agg(F.count_distinct("conv_id").alias("n_sessions"), F.count(F.lit(1)).alias("n_messages"))
    ratio = F.round(F.col("n_messages") / F.greatest("n_sessions", F.lit(1)), 1)
    return d.join(F.broadcast(c)).join(F.broadcast(m)).withColumn("per_session", ratio)  # one row each


def operation_summary(log: DataFrame) -> DataFrame:
    """action, n_ok, n_failed, total of an operation log with ok and amount."""
    return log.groupBy("action").agg(F.count_if(F.col("ok")).alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.sum("amount").alias("total"))
