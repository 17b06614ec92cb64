"""Changes of kept tables that say how many rows they have touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.sources.versioned import FileTable

from .lifecycle import REFERENCE_KINDS

#: The category that can't be deleted.
DEFAULT = "default"


def remove_document(chunks: FileTable, doc_id: int | None) -> int:
    """A document's chunks go; without an id none do."""
    return 0 if doc_id is None else chunks.delete(F.col("doc_id") == doc_id)


def delete_base(chunks: FileTable, kb_id: str) -> int:
    """A base's chunks go; 'all' clears the table."""
    return chunks.clear() if kb_id == "all" else chunks.delete(F.col("kb_id") == kb_id)


def owned_by(doc_id: int) -> Column:
    """The chunks of a document by the beginning of their ids, for stores that keep no document ids."""
    return F.col("chunk_id").startswith(f"{doc_id}_")


def count_by_prefix(chunks: FileTable, doc_id: int) -> int:
    return chunks.read().filter(owned_by(doc_id)).count()


def remove_by_prefix(chunks: FileTable, doc_id: int) -> int:
    return chunks.delete(owned_by(doc_id))


def recategorise(chunks: FileTable, condition: Column, category: str) -> int:
    """The number of chunks that get the category, those that have it already among them."""
    return chunks.update(condition, {"category": F.lit(category)})


def recategorise_document(docs: FileTable, chunks: FileTable, log: FileTable, doc_id: int, category: str, operator: str, ts: Column) -> tuple[int, int]:
    """Documents and chunks that get the category; a change is logged, a document that isn't there is none."""
    changed = recategorise(docs, F.col("doc_id") == doc_id, category)
    touched = recategorise(chunks, F.col("doc_id") == doc_id, category) if changed else 0
    if changed:
        row = log.spark.range(1).select(ts.alias("ts"), F.lit(operator).alias("operator"), F.lit("update_category").alias("action"), F.lit(doc_id).cast("long").alias("doc_id"), F.lit(category).alias("target"), F.lit(touched).cast("long").alias("chunks_updated"))
        log.append(row)
    return changed, touched


def create_references(references: FileTable, rows: DataFrame) -> int:
    """New references (ref_id, kind and others); a kind that isn't known is 'other', an id that is taken adds nothing."""
    kinds = rows.withColumn("kind", F.when(F.col("kind").isin(list(REFERENCE_KINDS)), F.col("kind")).otherwise("other")).dropDuplicates(["ref_id"])
    return references.append(kinds.join(references.read().select("ref_id"), "ref_id", "left_anti"))


def put_categories(categories: FileTable, rows: DataFrame) -> tuple[int, int]:
    """Categories (name, strategy, chunk_size, overlap) are created or changed: how many were there, how many are put."""
    return categories.upsert(rows, ["name"])


def delete_category(categories: FileTable, docs: FileTable, name: str) -> tuple[int, int]:
    """How many categories go, and how many documents fall back to the default, which itself stays."""
    if name == DEFAULT:
        return 0, 0
    gone = categories.delete(F.col("name") == name)
    return gone, docs.update(F.col("category") == name, {"category": F.lit(DEFAULT)}) if gone else 0


def put_chat_stats(stats: FileTable, sessions: int, messages: int) -> tuple[int, int]:
    """The one row of counts (id 1) is replaced."""
    row = stats.spark.range(1).select(F.lit(1).alias("id"), F.lit(sessions).cast("long").alias("total_sessions"), F.lit(messages).cast("long").alias("total_messages"))
    return stats.upsert(row, ["id"])
