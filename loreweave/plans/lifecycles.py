"""Sessions, versions, categories, tags, references and migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.text import citation
from loreweave.operators import lifecycle as L
from loreweave.operators import sessions as S
from loreweave.sources.tables import audit, documents, messages, table, vectors

from .chunks import FIXED_SQL, base_chunks
from .registry import query

_NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def memory_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.memory_window(messages(spark, sf_dir), 2)


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id < 50 UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE conv_id >= 50 AND role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 12")
def memory_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return S.synced_memory(m.filter("conv_id < 50"), m)


_TOPIC = r"""
SELECT *, coalesce(last_value(CASE WHEN role = 'user' AND length(trim(text)) >= 4 AND trim(text) NOT IN ('你好', 'hi', 'hello', '在吗', '帮助', 'help') THEN regexp_replace(text, '^\s+|\s+$', '', 'g') END IGNORE NULLS) OVER w, '') AS topic, count(*) OVER w > 0 AS has_history
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query(f"SELECT conv_id, turn, topic, has_history FROM ({_TOPIC})")
def topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_topic(messages(spark, sf_dir)).select("conv_id", "turn", "topic", "has_history")


@query("SELECT conv_id, max_by(text, turn) AS topic FROM conversations WHERE role = 'user' AND length(text) > 15 GROUP BY conv_id")
def topic_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.long_topic(messages(spark, sf_dir))


_FOLLOW_UP = "它呢"


@query(f"""
WITH planted AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND (conv_id + turn) % 3 = 0 THEN '{_FOLLOW_UP}' ELSE text END AS text FROM conversations)
SELECT conv_id, turn, has_history AND text = '{_FOLLOW_UP}' AS is_follow_up, CASE WHEN has_history AND text = '{_FOLLOW_UP}' AND topic <> '' THEN topic || ' ' || text ELSE text END AS query
FROM ({_TOPIC.replace('FROM conversations', 'FROM planted')}) WHERE role = 'user'""")
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third message of a user asks on, so it stands behind what the user asked before."""
    text = F.when((F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 3 == 0), _FOLLOW_UP).otherwise(F.col("text"))
    return S.expanded_queries(messages(spark, sf_dir).withColumn("text", text)).select("conv_id", "turn", "is_follow_up", "query")


@query("SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'")
def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exchanges(messages(spark, sf_dir))


@query("SELECT conv_id, 'You answer.' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prompt(messages(spark, sf_dir), "You answer.")


@query(r"SELECT lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS question, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1 ORDER BY n DESC, question LIMIT 10")
def hot_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hot_questions(messages(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.missing(documents(spark, sf_dir), table(spark, sf_dir, "labels")).select("doc_id")


@query("SELECT CASE WHEN d.doc_id IS NULL THEN 'not_found' WHEN source = 'src1' THEN 'unchanged' ELSE 'migrated' END AS status, x AS doc_id FROM (SELECT DISTINCT item_id * 50 AS x FROM benchmark) LEFT JOIN documents d ON d.doc_id = x")
def category_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 50).alias("doc_id"))
    return L.migrate(documents(spark, sf_dir), wanted, "src1")[1]


@query("SELECT CASE WHEN doc_id IN (SELECT item_id * 50 FROM benchmark) THEN 'src1' ELSE source END AS category, count(*) AS n FROM documents GROUP BY 1")
def category_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 50).alias("doc_id"))
    return L.migrate(documents(spark, sf_dir), wanted, "src1")[0].groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(c.category, d.category) AS category, coalesce(strategy, 'recursive') AS strategy, coalesce(chunk_size, 500) AS chunk_size, coalesce(overlap, 100) AS overlap, coalesce(n, 0) AS n_docs FROM (VALUES ('src1', 'fixed', 400, 80), ('unused', 'semantic', 300, 0)) c(category, strategy, chunk_size, overlap) FULL JOIN (SELECT source AS category, count(*) AS n FROM documents GROUP BY 1) d ON c.category = d.category")
def category_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    configured = spark.createDataFrame([("src1", "fixed", 400, 80), ("unused", "semantic", 300, 0)], "category string, strategy string, chunk_size int, overlap int")
    return L.categories(configured, documents(spark, sf_dir))


def _bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels, deleted on as many days before now as their id has in units of three hours."""
    gone = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    items = L.to_bin(gone, now())
    shift = F.make_dt_interval(hours=(F.col("doc_id") % 100).cast("int") * 3)
    return items.withColumn("deleted_at", F.col("deleted_at") - shift).withColumn("expires_at", F.col("expires_at") - shift)


_BIN = f"SELECT doc_id, {_NOW} - to_hours(CAST(doc_id % 100 * 3 AS INTEGER)) AS deleted_at, {_NOW} + INTERVAL 7 DAY - to_hours(CAST(doc_id % 100 * 3 AS INTEGER)) AS expires_at FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


@query(f"SELECT doc_id, greatest(0.0, round((epoch(expires_at) - epoch({_NOW})) / 86400, 1))::DOUBLE AS remaining_days FROM ({_BIN}) WHERE expires_at > {_NOW}")
def recycle_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.listed_bin(_bin(spark, sf_dir), now()).select("doc_id", "remaining_days")


@query(f"SELECT doc_id FROM ({_BIN}) WHERE NOT expires_at < {_NOW}")
def recycle_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.purged_bin(_bin(spark, sf_dir), now()).select("doc_id")


@query(f"""
WITH b AS ({_BIN})
SELECT doc_id, source AS category, CAST(length(text) AS INTEGER) AS n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT d.doc_id + 1000000, source, CAST(least(length(text), 10000) AS INTEGER) FROM documents d JOIN b ON b.doc_id = d.doc_id WHERE expires_at > {_NOW} AND d.doc_id % 2 = 0""")
def recycle_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live documents and the even ones of the bin, back under new ids."""
    items = _bin(spark, sf_dir)
    wanted = items.filter("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") + 1000000).alias("new_id"))
    live = L.missing(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return L.restored(live, items, wanted, now())[0].select("doc_id", "category", F.length("content").alias("n_chars"))


@query(f"""
SELECT kb_id, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs
FROM (SELECT c.doc_id, CASE WHEN c.doc_id IN (SELECT doc_id FROM labels) THEN 'moved' ELSE lang END AS kb_id FROM ({FIXED_SQL}) c JOIN documents d ON d.doc_id = c.doc_id) GROUP BY 1""")
def kb_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = L.moved_to_base(documents(spark, sf_dir), base_chunks(spark, sf_dir), table(spark, sf_dir, "labels"), "moved")[1]
    return chunks.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))


@query("SELECT doc_id, lang AS kb_id FROM documents WHERE lang <> 'fr'")
def kb_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.without_base(documents(spark, sf_dir), base_chunks(spark, sf_dir), "fr")[0].select("doc_id", "kb_id")


@query("SELECT CASE WHEN source = 'src1' THEN 'default' ELSE source END AS category, count(*) AS n_docs FROM documents GROUP BY 1")
def category_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    configured = spark.createDataFrame([("src1",), ("default",)], "name string")
    return L.without_category(configured, documents(spark, sf_dir), "src1", "default")[1].groupBy("category").agg(F.count(F.lit(1)).alias("n_docs"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of a user is a version of the user's document."""
    events = audit(spark, sf_dir)
    return L.number_versions(events.select(F.col("username").cast("long").alias("doc_id"), F.struct("ts", "event_id").alias("at"), F.col("action").alias("content")))


_VERSIONS = "SELECT user_id AS doc_id, event_type AS content, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50"


@query(f"SELECT doc_id, version, CAST(length(content) AS INTEGER) AS n_chars FROM ({_VERSIONS})")
def version_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("doc_id", "version", F.length("content").alias("n_chars"))


@query(f"SELECT doc_id, version, content FROM ({_VERSIONS}) WHERE doc_id = 7 AND version = 40")
def version_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.version_of(_versions(spark, sf_dir), 7, 40).select("doc_id", "version", "content")


@query(f"SELECT doc_id, count(*) AS n FROM ({_VERSIONS}) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY doc_id")
def versions_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each document that are left when those of low quality lose theirs."""
    gone = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    return L.delete_versions(_versions(spark, sf_dir), gone).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension, (SELECT count(*) FROM embeddings) AS total, CAST((SELECT ceil(count(*) / 25.0) FROM embeddings) AS INTEGER) AS total_pages FROM embeddings ORDER BY vec_id LIMIT 25 OFFSET 25")
def vectors_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the vectors, with the true length of each."""
    return L.listed_with_dimension(vectors(spark, sf_dir), 2, 25)


@query(f"WITH v AS ({_VERSIONS}), o AS (SELECT * FROM v WHERE doc_id = (SELECT min(doc_id) FROM v)) SELECT doc_id, content, version FROM o UNION ALL SELECT doc_id, content, CAST((SELECT max(version) FROM o) + 1 AS INTEGER) FROM o WHERE version = (SELECT min(version) FROM o)")
def version_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir).select("doc_id", "version", "content")
    first = v.agg(F.min(F.struct("doc_id", "version")).alias("f")).select("f.*").first()
    mine = v.filter(F.col("doc_id") == first["doc_id"])
    return L.roll_back(mine, first["doc_id"], first["version"])


@query("SELECT a.event_id, array_to_string(list_sort(list_concat(CASE WHEN a.event_type <> b.event_type THEN ['action'] ELSE []::VARCHAR[] END, CASE WHEN a.user_id <> b.user_id THEN ['user'] ELSE []::VARCHAR[] END)), ',') AS changed FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def version_meta_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = audit(spark, sf_dir).select("event_id", F.create_map(F.lit("action"), "action", F.lit("user"), "username").alias("m"))
    after = meta.select((F.col("event_id") - 1).alias("event_id"), F.col("m").alias("n"))
    return meta.join(after, "event_id").select("event_id", F.array_join(L.map_changes(F.col("m"), F.col("n")), ",").alias("changed"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.split("p_name", " ").alias("tags"))


@query("SELECT t AS tag, count(DISTINCT p_partkey) AS n_docs FROM (SELECT p_partkey, lower(unnest(string_split(p_name, ' '))) AS t FROM part) GROUP BY 1 UNION ALL SELECT 'no such tag', 0")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _parts(spark, sf_dir)
    tags = tagged.select(F.explode("tags").alias("tag")).select(F.lower("tag").alias("tag")).distinct().unionByName(spark.range(1).select(F.lit("no such tag").alias("tag")))
    return L.tag_counts(tags, tagged)


@query("SELECT p_partkey AS doc_id FROM part WHERE list_contains(list_transform(string_split(p_name, ' '), lambda x: lower(x)), lower(split_part((SELECT min(p_name) FROM part), ' ', 1)))")
def tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _parts(spark, sf_dir)
    tag = table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0].split(" ")[0]
    return L.with_tag(tagged, tag).select("doc_id")


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as references."""
    s = table(spark, sf_dir, "supplier")
    kind = F.element_at(F.array(*map(F.lit, ("paper", "book", "website", "talk"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    year = F.when(F.col("s_nationkey") > 0, F.col("s_nationkey") + 2000)
    return s.select(F.col("s_suppkey").alias("ref_id"), F.col("s_name").alias("title"), year.alias("year"), kind.alias("kind"))


_KIND = "CASE s_suppkey % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'book' WHEN 2 THEN 'website' ELSE 'other' END"


@query(f"SELECT s_suppkey AS ref_id, s_name AS title, CASE WHEN s_nationkey > 0 THEN s_nationkey + 2000 END AS year, {_KIND} AS kind FROM supplier")
def reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.listed_references(_references(spark, sf_dir))


@query(f"SELECT s_suppkey AS ref_id, 'N. N.' || CASE WHEN {_KIND} = 'website' THEN '. ' || CASE WHEN s_nationkey > 0 THEN '(' || (s_nationkey + 2000) || ')' ELSE '' END || ' ' || s_name || '. http://x' ELSE CASE WHEN s_nationkey > 0 THEN ' (' || (s_nationkey + 2000) || ')' ELSE '' END || '. ' || s_name || '. Journal. http://x' END AS citation FROM supplier")
def citation_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.listed_references(_references(spark, sf_dir))
    return r.select("ref_id", citation(F.col("title"), F.array(F.lit("N. N.")), F.col("year"), F.lit("Journal"), F.lit("http://x"), F.col("kind"), F.lit(None).cast("string")).alias("citation"))


@query("SELECT o_orderkey AS doc_id, s_suppkey AS ref_id, s_name AS title FROM (SELECT o_orderkey, unnest([o_custkey % 10, o_custkey % 7]) AS r FROM orders) JOIN supplier ON r = s_suppkey")
def reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array(F.col("o_custkey") % 10, F.col("o_custkey") % 7).alias("ref_ids"))
    return L.references_of(docs, _references(spark, sf_dir)).select("doc_id", "ref_id", "title")


@query(f"WITH c AS ({FIXED_SQL}), f AS (SELECT doc_id, chunk_index FROM c WHERE contains(lower(text), 'worthless')) SELECT *, (SELECT count(*) FROM f) AS total, CAST(ceil((SELECT count(*) FROM f) / 20.0) AS INTEGER) AS total_pages FROM f ORDER BY doc_id, chunk_index LIMIT 20 OFFSET 20")
def chunks_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base_chunks(spark, sf_dir).filter(F.lower("text").contains("worthless")).select("doc_id", "chunk_index")
    return L.page(rows, [F.col("doc_id"), F.col("chunk_index")], 2, 20)


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1000000 + s_suppkey, s_name FROM supplier")
def migrate_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_name").alias("name"))
    return L.add_absent(have, new.unionByName(have), ["id"])


@query("SELECT doc_id, chunk_index, n FROM (SELECT doc_id, 0 AS chunk_index, 1 AS n FROM labels UNION ALL SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END, 2 FROM documents)")
def append_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("chunk_index"), F.lit(1).alias("n"))
    return L.append_chunks(have, documents(spark, sf_dir).select("doc_id", F.lit(0).alias("chunk_index"), F.lit(2).alias("n")))


@query("SELECT user_id, CASE WHEN max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 THEN '*,' ELSE '' END || array_to_string(list_sort(list_distinct(list(event_type) FILTER (event_type <> 'purchase'))), ',') AS permissions FROM events GROUP BY user_id")
def permission_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions as roles: 'purchase' is the administrator, the others grant themselves."""
    events = audit(spark, sf_dir).select(F.col("username").cast("long").alias("user_id"), F.when(F.col("action") == "purchase", "admin").otherwise(F.col("action")).alias("role"))
    users = events.groupBy("user_id").agg(F.collect_set("role").alias("roles"))
    roles = events.select("role").distinct().select("role", F.array("role").alias("permissions"))
    granted = L.permissions(users, roles)
    return granted.select("user_id", F.when(F.array_contains("permissions", "*"), F.concat(F.lit("*,"), F.array_join(F.array_remove("permissions", "*"), ","))).otherwise(F.array_join("permissions", ",")).alias("permissions"))
