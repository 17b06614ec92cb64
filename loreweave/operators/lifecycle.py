"""Documents over time: versions, recycle bin, categories, tags, references, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import tag_name, token_estimate
from loreweave.functions.vectors import hash_cells

from . import graph

KEPT_VERSIONS, BIN_DAYS, BIN_CHARS = 50, 7, 10_000
REFERENCE_KINDS = ("paper", "book", "website", "other")


def missing(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents without a chunk in the index."""
    return docs.join(indexed.select("doc_id"), "doc_id", "left_anti")


def add_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target and those rows whose keys it hasn't."""
    return target.unionByName(rows.join(target.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, and those of target that they don't replace."""
    return target.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def remove(target: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(ids.select(*keys), keys, "left_anti")


def append_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """chunks and new ones (doc_id, chunk_index, text), numbered on from what each document has."""
    have = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_have"))
    moved = new.join(have, "doc_id", "left").withColumn("chunk_index", (F.col("chunk_index") + F.coalesce("_have", F.lit(0))).cast("int")).drop("_have")
    return chunks.unionByName(moved)


def number_versions(versions: DataFrame) -> DataFrame:
    """The last versions of each document with their numbers from 1, in order of at."""
    own = Window.partitionBy("doc_id")
    numbered = versions.withColumn("version", F.row_number().over(own.orderBy("at"))).withColumn("_n", F.count(F.lit(1)).over(own))
    return numbered.filter(F.col("version") > F.col("_n") - KEPT_VERSIONS).drop("_n")


def roll_back(versions: DataFrame, doc_id: int, version: int) -> DataFrame:
    """versions and, as the document's newest, the content of an old one."""
    last = versions.filter(F.col("doc_id") == doc_id).agg(F.max("version").alias("_last"))
    old = versions.filter((F.col("doc_id") == doc_id) & (F.col("version") == version))
    return versions.unionByName(old.join(F.broadcast(last)).withColumn("version", (F.col("_last") + 1).cast("int")).drop("_last"))


def map_changes(old: Column, new: Column) -> Column:
    """Keys of two maps whose values differ, are new or are gone, in order."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.array_sort(F.filter(keys, lambda k: ~F.element_at(old, k).eqNullSafe(F.element_at(new, k))))


def to_bin(docs: DataFrame, now: Column) -> DataFrame:
    """Soft-deleted copies with cut contents, their other columns and the date they expire."""
    return docs.select(*(c for c in docs.columns if c != "content"), F.substring("content", 1, BIN_CHARS).alias("content"), now.alias("deleted_at"), (now + F.expr(f"INTERVAL {BIN_DAYS} DAYS")).alias("expires_at"))


def listed_bin(items: DataFrame, now: Column) -> DataFrame:
    """What hasn't expired, newest first, with the days that remain."""
    days = F.greatest(F.lit(0.0), F.round((F.col("expires_at").cast("double") - now.cast("double")) / 86400, 1))
    return items.filter(F.col("expires_at") > now).withColumn("remaining_days", days).orderBy(F.desc("deleted_at"), "doc_id")


def purged_bin(items: DataFrame, now: Column) -> DataFrame:
    return items.filter(~(F.col("expires_at") < now))


def restored(docs: DataFrame, items: DataFrame, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """docs with the wanted items (doc_id, new_id) of the bin under their new ids, and the bin without them.

    What has expired or isn't in the bin is left as it is.
    """
    back = items.filter(F.col("expires_at") > now).join(wanted.select("doc_id", "new_id").dropDuplicates(["doc_id"]), "doc_id")
    rows = back.drop("doc_id").withColumnRenamed("new_id", "doc_id")
    kept = [c for c in docs.columns if c in rows.columns]
    return docs.unionByName(rows.select(*kept), allowMissingColumns=True), items.join(back.select("doc_id"), "doc_id", "left_anti")


def moved_to_base(docs: DataFrame, chunks: DataFrame, wanted: DataFrame, kb_id: str) -> tuple[DataFrame, DataFrame]:
    """docs and chunks with those of the wanted ids in another base; the vectors move with their document."""
    ids = wanted.select("doc_id").distinct().withColumn("_w", F.lit(True))
    move = lambda rows: rows.join(ids, "doc_id", "left").withColumn("kb_id", F.when(F.col("_w"), kb_id).otherwise(F.col("kb_id"))).drop("_w")
    return move(docs), move(chunks)


def without_base(docs: DataFrame, chunks: DataFrame, kb_id: str) -> tuple[DataFrame, DataFrame]:
    """docs and chunks without a base's; rows without any base stay."""
    other = ~F.col("kb_id").eqNullSafe(F.lit(kb_id))
    return docs.filter(other), chunks.filter(other)


def without_category(configured: DataFrame, docs: DataFrame, name: str, default: str) -> tuple[DataFrame, DataFrame]:
    """The configured categories (name) without one, whose documents fall back to the default; the default itself can't go."""
    if name == default:
        return configured, docs
    return configured.filter(F.col("name") != name), docs.withColumn("category", F.when(F.col("category") == name, default).otherwise(F.col("category")))


def migrate(docs: DataFrame, wanted: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """docs with the wanted ones (doc_id) moved to a category, and doc_id, status for each wanted id."""
    ids = wanted.select("doc_id").distinct()
    moved = docs.join(ids.withColumn("_w", F.lit(True)), "doc_id", "left").withColumn("category", F.when(F.col("_w"), target).otherwise(F.col("category"))).drop("_w")
    status = ids.join(docs.select("doc_id", F.col("category").alias("_c")), "doc_id", "left").select("doc_id", F.when(F.col("_c").isNull(), "not_found").when(F.col("_c") == target, "unchanged").otherwise("migrated").alias("status"))
    return moved, status


def categories(configured: DataFrame, docs: DataFrame) -> DataFrame:
    """Configured and used categories with strategy, size, overlap and their number of documents."""
    used = docs.groupBy("category").agg(F.count(F.lit(1)).alias("n_docs"))
    both = configured.join(used, "category", "full_outer")
    return both.select("category", F.coalesce("strategy", F.lit("recursive")).alias("strategy"), F.coalesce("chunk_size", F.lit(500)).alias("chunk_size"), F.coalesce("overlap", F.lit(100)).alias("overlap"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def tag_counts(tags: DataFrame, tagged: DataFrame) -> DataFrame:
    """Every tag with the documents that have it, 0 for none; by number, then name. tagged: doc_id, tags (array)."""
    used = tagged.select("doc_id", F.explode("tags").alias("_t")).select("doc_id", tag_name(F.col("_t")).alias("tag")).distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("_n"))
    return tags.join(used, "tag", "left").select("tag", F.coalesce("_n", F.lit(0)).alias("n_docs")).orderBy(F.desc("n_docs"), "tag")


def with_tag(tagged: DataFrame, tag: str) -> DataFrame:
    return tagged.filter(F.array_contains(F.transform("tags", tag_name), tag.strip().lower()))


def references_of(docs: DataFrame, references: DataFrame) -> DataFrame:
    """docs (doc_id, ref_ids) with their references."""
    return docs.select("doc_id", F.explode("ref_ids").alias("ref_id")).join(references, "ref_id")


def attach_references(ref_ids: Column, more: Column) -> Column:
    return F.array_sort(F.array_union(ref_ids, more))


def listed_references(references: DataFrame, kind: str | None = None) -> DataFrame:
    kinds = references.withColumn("kind", F.when(F.col("kind").isin(list(REFERENCE_KINDS)), F.col("kind")).otherwise("other"))
    return (kinds.filter(F.col("kind") == kind) if kind else kinds).orderBy(F.desc(F.coalesce("year", F.lit(0))), "title")


def indexed(docs: DataFrame, cut: Column) -> DataFrame:
    """doc_id, chunk_index, total_chunks, text, token_count, cells: the chunks of docs (doc_id, content and others) with their embeddings.

    cut is the expression of a chunker: an array of texts. All is made inside the
    row, so a full index is one pass over the documents. Documents without chunks give none.
    """
    cut_up = docs.select("doc_id", cut.alias("_c")).select("doc_id", F.size("_c").alias("total_chunks"), F.posexplode("_c").alias("chunk_index", "text"))
    return cut_up.select("doc_id", "chunk_index", "total_chunks", "text", token_estimate(F.col("text")).alias("token_count"), hash_cells(F.col("text")).alias("cells"))


def index_report(docs: DataFrame, index: DataFrame) -> DataFrame:
    """One row: documents, indexed ones, those without chunks, chunks."""
    made = index.agg(F.count_distinct("doc_id").alias("n_indexed"), F.count(F.lit(1)).alias("n_chunks"))
    both = docs.agg(F.count_distinct("doc_id").alias("n_docs")).join(F.broadcast(made))  # one row each
    return both.select("n_docs", "n_indexed", (F.col("n_docs") - F.col("n_indexed")).alias("n_empty"), "n_chunks")


def reindexed(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """chunks with those of the documents in new replaced."""
    return upsert(chunks, new, ["doc_id"])


def permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """user_id, permissions: the union over a user's roles; 'admin' has '*'. users: user_id, roles (array)."""
    granted = users.select("user_id", F.explode("roles").alias("role")).join(roles, "role")
    return granted.groupBy("user_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == "admin", F.array(F.lit("*"))).otherwise(F.col("permissions")))))).alias("permissions"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows with the total and the number of pages."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    cut = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return cut.join(F.broadcast(total)).withColumn("total_pages", F.ceil(F.col("total") / F.lit(size)).cast("int"))


def soft_deleted(docs: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, ids: DataFrame, now: Column) -> dict[str, DataFrame]:
    """docs, chunks, nodes, edges without the documents in ids (column doc_id), and bin, what is kept of them for BIN_DAYS."""
    gone = docs.join(ids.select("doc_id"), "doc_id", "left_semi")
    kept_nodes, kept_edges = without_documents(nodes, edges, ids)
    held = gone.withColumn("content", F.substring("content", 1, BIN_CHARS)).withColumn("deleted_at", now).withColumn("expires_at", now + F.expr(f"INTERVAL {BIN_DAYS} DAYS"))
    return {"docs": remove(docs, ids, ["doc_id"]), "chunks": remove(chunks, ids, ["doc_id"]), "nodes": kept_nodes, "edges": kept_edges, "bin": held}


def without_documents(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph without the nodes of documents and without entities that lose all their edges."""
    told = ids.select(graph.document_node(F.col("doc_id")).alias("id")).distinct()
    nodes, edges = graph.without(nodes, edges, told)
    return graph.without(nodes, edges, graph.orphan_entities(nodes, edges))


def create_base(bases: DataFrame, base_id: str, name: str, description: str, at: str) -> DataFrame:
    """bases (id, name, description, created_at, doc_count) with a new one; a name that is taken raises an error."""
    if not bases.filter(F.col("name") == name).isEmpty():
        raise ValueError(f"there is a base named {name}")
    return bases.unionByName(bases.sparkSession.createDataFrame([(base_id, name, description, at, 0)], bases.schema))


def delete_base(bases: DataFrame, docs: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, base_id: str) -> dict[str, DataFrame]:
    """All tables without a base, its documents, their chunks and their part of the graph."""
    ids = docs.filter(F.col("kb_id") == base_id).select("doc_id")
    kept_nodes, kept_edges = without_documents(nodes, edges, ids)
    return {"bases": bases.filter(F.col("id") != base_id), "docs": remove(docs, ids, ["doc_id"]), "chunks": remove(chunks, ids, ["doc_id"]), "nodes": kept_nodes, "edges": kept_edges}


def move_documents(docs: DataFrame, chunks: DataFrame, nodes: DataFrame, ids: DataFrame, base_id: str) -> dict[str, DataFrame]:
    """docs, chunks and nodes with the base of the documents in ids changed; edges stay, since ids of nodes do."""
    told = ids.select("doc_id", F.lit(base_id).alias("_to")).distinct()
    moved = lambda rows: rows.join(told, "doc_id", "left").withColumn("kb_id", F.coalesce("_to", "kb_id")).drop("_to").select(rows.columns)
    return {"docs": moved(docs), "chunks": moved(chunks), "nodes": moved(nodes)}


def delete_versions(versions: DataFrame, ids: DataFrame) -> DataFrame:
    return remove(versions, ids, ["doc_id"])


def version_of(versions: DataFrame, doc_id: int, number: int) -> DataFrame:
    return versions.filter((F.col("doc_id") == doc_id) & (F.col("version") == number))


def delete_by_prefix(chunks: DataFrame, docs: DataFrame, base_id: str) -> DataFrame:
    """Chunks whose id's part before '_chunk_' is not a document of the base: the way of stores that know no document ids."""
    ids = docs.filter(F.col("kb_id") == base_id).select(F.col("doc_id").cast("string").alias("_owner"))
    return chunks.withColumn("_owner", F.substring_index("chunk_id", "_chunk_", 1)).join(ids, "_owner", "left_anti").drop("_owner")


def listed_with_dimension(vectors: DataFrame, number: int, size: int) -> DataFrame:
    """A page of vectors (vec_id, embedding) with the true dimension of each."""
    rows = vectors.select("vec_id", F.size("embedding").alias("dimension"))
    return page(rows, [F.col("vec_id")], number, size)


def add_exchange(messages: DataFrame, session_id: int, question: str, answer: str) -> DataFrame:
    """messages (conv_id, turn, role, text) with a question and its answer behind a session's last turn."""
    last = messages.filter(F.col("conv_id") == session_id).agg(F.coalesce(F.max("turn"), F.lit(-1)).alias("_t"))
    rows = F.array(*(F.struct(F.lit(k).alias("_k"), F.lit(r).alias("role"), F.lit(t).alias("text")) for k, (r, t) in enumerate((("user", question), ("assistant", answer)), 1)))
    new = last.select("_t", F.inline(rows)).select(F.lit(session_id).cast("long").alias("conv_id"), (F.col("_t") + F.col("_k")).cast("long").alias("turn"), "role", "text")
    return messages.unionByName(new)
