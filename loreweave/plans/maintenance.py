"""Updates, deletions and projections, as before-and-after queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.operators import answers as A
from loreweave.operators import chunking as C
from loreweave.operators import graph as G
from loreweave.operators import linediff as D
from loreweave.operators import lifecycle as L
from loreweave.operators import retrieval as R
from loreweave.operators import stats
from loreweave.sources.tables import audit, documents, messages, table

from .chunks import CELLS_SQL, FIXED_SQL, base_chunks
from .graphs import _BASE, GRAPH_SQL, graph_of
from .hybrid import WORDS, keyword_sql
from .registry import query

_CHUNKS = f"WITH c AS (SELECT f.*, source AS category, lang AS kb_id FROM ({FIXED_SQL}) f JOIN documents d USING (doc_id))"


@query(f"{_CHUNKS} SELECT doc_id, chunk_index FROM c WHERE doc_id <> 7")
def delete_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.range(1).select(F.lit(7).cast("long").alias("doc_id"))
    return L.remove(base_chunks(spark, sf_dir), gone, ["doc_id"]).select("doc_id", "chunk_index")


@query(f"{_CHUNKS} SELECT kb_id, count(*) AS n FROM c WHERE kb_id <> 'fr' GROUP BY kb_id")
def delete_kb_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top(base_chunks(spark, sf_dir).filter("kb_id <> 'fr'"), "kb_id")


@query(f"{_CHUNKS} SELECT CASE WHEN category = 'src1' THEN 'moved' ELSE category END AS category, count(*) AS n FROM c GROUP BY 1")
def update_chunk_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = base_chunks(spark, sf_dir).withColumn("category", F.when(F.col("category") == "src1", "moved").otherwise(F.col("category")))
    return stats.top(moved, "category")


@query(f"{_CHUNKS} SELECT doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM c")
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_chunks(spark, sf_dir).select("doc_id", "chunk_index", F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("total_chunks"))


@query(f"{_CHUNKS} SELECT doc_id, string_agg(chunk_index || ':' || length(text), ',' ORDER BY chunk_index) AS chunks FROM c GROUP BY doc_id")
def chunks_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("chunk_index", F.length("text").alias("n"))))
    grouped = base_chunks(spark, sf_dir).groupBy("doc_id").agg(listed.alias("l"))
    return grouped.select("doc_id", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["chunk_index"].cast("string"), x["n"].cast("string"))), ",").alias("chunks"))


@query(f"WITH c AS ({FIXED_SQL}), d AS (SELECT doc_id, chunk_index, count(*) AS n FROM ({CELLS_SQL('doc_id, chunk_index', 'c')}) GROUP BY ALL) SELECT doc_id, chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks, md5(text) AS digest, CAST(n AS INTEGER) AS n_cells FROM c JOIN d USING (doc_id, chunk_index)")
def reindex_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and embedded anew."""
    index = L.indexed(documents(spark, sf_dir), C.fixed(F.col("content")))
    return index.select("doc_id", "chunk_index", "total_chunks", F.md5("text").alias("digest"), F.size("cells").alias("n_cells"))


@query(f"WITH c AS ({FIXED_SQL}) SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, count(DISTINCT doc_id) AS n_indexed, (SELECT count(DISTINCT doc_id) FROM documents) - count(DISTINCT doc_id) AS n_empty, count(*) AS n_chunks FROM c")
def reindex_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return L.index_report(docs, docs.select("doc_id", F.explode(C.fixed(F.col("content")))))


@query(f"""
WITH c AS ({FIXED_SQL}), l AS (SELECT doc_id FROM labels WHERE toxic = 1),
w AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(text, i * 450 + 1, 500) AS text FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 450.0) AS BIGINT))) AS i FROM documents WHERE doc_id IN (SELECT doc_id FROM l))),
b AS (SELECT doc_id, chunk_index, text FROM c WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT doc_id, chunk_index, text FROM w),
e AS (SELECT doc_id, chunk_index, count(*) AS n FROM ({CELLS_SQL('doc_id, chunk_index', 'b')}) GROUP BY ALL)
SELECT doc_id, chunk_index, md5(text) AS digest, CAST(coalesce(n, 0) AS INTEGER) AS n_cells FROM b LEFT JOIN e USING (doc_id, chunk_index)""")
def reindex_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index, in which documents with the label are cut by another strategy and embedded anew."""
    docs = documents(spark, sf_dir)
    some = docs.join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    index = L.reindexed(L.indexed(docs, C.fixed(F.col("content"))), L.indexed(some, C.naive(F.col("content"))))
    return index.select("doc_id", "chunk_index", F.md5("text").alias("digest"), F.size("cells").alias("n_cells"))


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")


_LEFT = f"""{{0}}, gone AS ({{1}}), l AS (SELECT * FROM edges WHERE source NOT IN (SELECT 'doc_' || doc_id FROM gone)),
n AS (SELECT * FROM nodes WHERE (category = 'document' AND doc_id NOT IN (SELECT doc_id FROM gone)) OR (category = 'entity' AND id IN (SELECT target FROM l)))"""


@query(f"WITH {_LEFT.format(GRAPH_SQL, 'SELECT doc_id FROM labels WHERE toxic = 1')}, c AS ({FIXED_SQL}) SELECT 'docs' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'chunks', count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'nodes', count(*) FROM n UNION ALL SELECT 'edges', count(*) FROM l UNION ALL SELECT 'bin', count(*) FROM gone")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the label go to the bin, with chunks and graph."""
    left = L.soft_deleted(documents(spark, sf_dir), base_chunks(spark, sf_dir), *graph_of(spark, sf_dir), _gone(spark, sf_dir), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return reduce(DataFrame.unionByName, (rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")).select("kind", "n") for kind, rows in left.items()))


@query(f"WITH {_LEFT.format(GRAPH_SQL, "SELECT doc_id FROM documents WHERE lang = 'fr'")}, c AS ({FIXED_SQL}) SELECT 'bases' AS kind, 1 AS n UNION ALL SELECT 'docs', count(*) FROM documents WHERE lang <> 'fr' UNION ALL SELECT 'chunks', count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'nodes', count(*) FROM n UNION ALL SELECT 'edges', count(*) FROM l")
def base_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base goes with its documents, chunks and graph; another was created before."""
    bases = spark.createDataFrame([("fr", "French", "", "2024", 0)], "id string, name string, description string, created_at string, doc_count int")
    bases = L.create_base(bases, "xx", "Other", "", "2024")
    left = L.delete_base(bases, documents(spark, sf_dir), base_chunks(spark, sf_dir), *graph_of(spark, sf_dir), "fr")
    return reduce(DataFrame.unionByName, (rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")).select("kind", "n") for kind, rows in left.items()))


@query(f"WITH {GRAPH_SQL}, m AS (SELECT doc_id FROM labels WHERE quality = 0), c AS ({FIXED_SQL}) SELECT 'docs' AS kind, count(*) AS n FROM m UNION ALL SELECT 'chunks', count(*) FROM c WHERE doc_id IN (SELECT doc_id FROM m) UNION ALL SELECT 'nodes', count(*) FROM m")
def base_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, chunks and nodes of documents of low quality after their move to a base of their own."""
    low = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    left = L.move_documents(documents(spark, sf_dir), base_chunks(spark, sf_dir), graph_of(spark, sf_dir)[0], low, "low")
    return reduce(DataFrame.unionByName, (rows.agg(F.lit(kind).alias("kind"), F.count_if(F.col("kb_id") == "low").alias("n")).select("kind", "n") for kind, rows in left.items()))


@query(f"WITH c AS ({FIXED_SQL}) SELECT doc_id || '_chunk_' || chunk_index AS chunk_id FROM c JOIN documents USING (doc_id) WHERE lang <> 'en'")
def delete_chunks_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = base_chunks(spark, sf_dir).select(F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"))
    return L.delete_by_prefix(chunks, documents(spark, sf_dir), "en")


@query("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT 0, (SELECT coalesce(max(turn), -1) FROM conversations WHERE conv_id = 0) + k, r, t FROM (VALUES (1, 'user', 'why?'), (2, 'assistant', 'so')) v(k, r, t)")
def session_add_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.add_exchange(messages(spark, sf_dir), 0, "why?", "so")


@query("SELECT lang AS kb_id, count(*) AS n_docs, string_agg(DISTINCT source, ',' ORDER BY source) AS categories FROM documents GROUP BY lang")
def kb_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_docs"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


@query("SELECT DISTINCT source AS category FROM documents UNION SELECT 'declared'")
def all_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("category").unionByName(spark.range(1).select(F.lit("declared").alias("category"))).distinct()


@query("SELECT doc_id, source AS category FROM documents WHERE contains(lower('doc_' || doc_id), '9') OR contains(lower(source), 'src1')")
def client_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).filter(F.lower("title").contains("9") | F.lower("category").contains("src1")).select("doc_id", "category")


@query("SELECT doc_id, source AS category, lang AS kb_id FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).filter(R.matches(["src1", "src2"], "en")).select("doc_id", "category", "kb_id")


@query("SELECT doc_id, 'doc_' || doc_id AS title, text AS content FROM documents WHERE doc_id = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).filter("doc_id = 42").select("doc_id", "title", "content")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def task_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("username").orderBy(F.desc("ts"), F.desc("event_id"))
    return audit(spark, sf_dir).withColumn("_r", F.row_number().over(w)).filter("_r <= 50").select(F.col("username").cast("long").alias("user_id"), "event_id")


@query(f"WITH {_BASE}, v AS (SELECT id FROM nodes WHERE category = 'document' AND kb_id = 'en' OR category = 'entity' AND name < 'M') SELECT source, target, type FROM edges WHERE source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)")
def graph_visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph_of(spark, sf_dir)
    seen = nodes.filter("category = 'document' AND kb_id = 'en' OR category = 'entity' AND name < 'M'").select("id")
    return edges.join(seen.withColumnRenamed("id", "source"), "source", "left_semi").join(seen.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "type")


@query(f"WITH {_BASE} SELECT DISTINCT o AS id FROM (SELECT target AS o FROM edges WHERE source = 'doc_7' UNION ALL SELECT source FROM edges WHERE target = 'doc_7')")
def graph_hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph_of(spark, sf_dir)
    return G.neighbours(nodes, edges, "doc_7").select("id").distinct()


@query(f"WITH {_BASE} SELECT id, name FROM nodes WHERE contains(lower(name), 'worth')")
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = graph_of(spark, sf_dir)
    return nodes.join(G.seeds_for(nodes, ["worth"]), "id", "left_semi").select("id", "name")


@query(f"WITH k AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({keyword_sql(WORDS, 5)})) SELECT string_agg(snippet, chr(10) ORDER BY r) AS answer, max(score) AS confidence FROM k WHERE r <= 3")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.ranked(R.keyword_search(documents(spark, sf_dir), WORDS, 5).withColumn("query_id", F.lit(0)), ["query_id"], "score", "doc_id", 5)
    return A.extractive_answer(hits).select("answer", "confidence")


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, ls, len(ls) - 1 AS old, greatest(len(ls) - 4, 0) AS cut FROM l)
SELECT doc_id, CASE WHEN old = 0 THEN 0 ELSE 1 END AS added, 0 AS removed,
    CASE WHEN old = 0 THEN '' ELSE '--- old' || chr(10) || '+++ new' || chr(10) || '@@ -' || (cut + 1) || CASE WHEN old - cut = 1 THEN '' ELSE ',' || (old - cut) END || ' +' || (cut + 1) || ',' || (old - cut + 1) || ' @@' || chr(10)
        || array_to_string(list_transform(ls[cut + 1:old], lambda x: ' ' || x), chr(10)) || chr(10) || '+' || ls[old + 1] END AS diff FROM n""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its text without the last line."""
    docs = documents(spark, sf_dir).select("doc_id", F.regexp_replace("content", r"\n[^\n]*$", "").alias("old"), F.col("content").alias("new"))
    changes = D.line_changes(docs, "doc_id")
    return D.change_counts(changes, "doc_id").join(D.unified(changes, "doc_id"), "doc_id")


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, ls, len(ls) AS n, len(ls) // 2 AS k FROM l)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS added, CASE doc_id % 3 WHEN 0 THEN least(n, 2) WHEN 1 THEN 1 ELSE 0 END AS removed, n - CASE doc_id % 3 WHEN 0 THEN least(n, 2) WHEN 1 THEN 1 ELSE 0 END AS same
FROM n WHERE n > 2""")
def version_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of more than two lines against versions without their first two, with another in the middle, or with two more there."""
    lines = documents(spark, sf_dir).select("doc_id", F.col("content").alias("old"), F.split("content", "\n", -1).alias("l")).filter(F.size("l") > 2).withColumn("k", F.floor(F.size("l") / 2).cast("int"))
    put = lambda *new: F.concat(F.slice("l", F.lit(1), F.col("k")), F.array(*(F.concat(F.lit(x), F.col("doc_id").cast("string")) for x in new)))
    new = F.when(F.col("doc_id") % 3 == 0, F.slice("l", 3, F.size("l"))).when(F.col("doc_id") % 3 == 1, F.concat(put("other "), F.slice("l", F.col("k") + 2, F.size("l")))).otherwise(F.concat(put("one ", "two "), F.slice("l", F.col("k") + 1, F.size("l"))))
    changes = D.line_changes(lines.select("doc_id", "old", F.array_join(new, "\n").alias("new")), "doc_id")
    same = changes.groupBy("doc_id").agg(F.count_if(F.col("op") == " ").alias("same"))
    return D.change_counts(changes, "doc_id").join(same, "doc_id")


@query("SELECT c_custkey, c_mktsegment, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def customers_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("_n"))
    return table(spark, sf_dir, "customer").join(counts, "c_custkey", "left").select("c_custkey", "c_mktsegment", F.coalesce("_n", F.lit(0)).alias("n"))
