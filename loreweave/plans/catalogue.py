"""Look-ups and projections over the driver's tables, and texts that are cleaned piece by piece."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import intent as I
from loreweave.functions.text import normalise
from loreweave.operators import catalogue as K
from loreweave.operators import chunking as C
from loreweave.operators import retrieval as R
from loreweave.operators.chain import Chain
from loreweave.sources.checkpoints import shared_folder
from loreweave.sources.tables import documents, messages, table
from loreweave.streaming.cleaning import clean_stream

from .chunks import FIXED_SQL, base_chunks
from .hybrid import WORDS, keyword_sql
from .registry import query

_EDITS = "c_custkey % 7 = 0 OR c_mktsegment IN ('BUILDING', 'AUTOMOBILE')"


@query(f"SELECT c_custkey AS user_id, {_EDITS} AS allowed FROM customer")
def permission_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who may write documents or graphs: editors by their segment, and every seventh, an admin."""
    role = F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "editor").otherwise("viewer")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.array_compact(F.array(role, F.when(F.col("c_custkey") % 7 == 0, "admin"))).alias("roles"))
    return K.with_any_permission(users, ["doc:write", "graph:write"])


@query(f"WITH c AS ({FIXED_SQL}) SELECT doc_id, doc_id || '_chunk_' || chunk_index AS chunk_id, text FROM c WHERE doc_id = 7 AND chunk_index = 0")
def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = base_chunks(spark, sf_dir).withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")))
    return K.chunk_of(chunks, 7, "7_chunk_0").select("doc_id", "chunk_id", "text")


@query(f"SELECT substr(d.text, 1, 500) AS snippet, d.doc_id AS id, 'doc_' || d.doc_id AS title, d.source AS category, k.score FROM ({keyword_sql(WORDS, 20)}) k JOIN documents d USING (doc_id)")
def result_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits as a search page shows them."""
    docs = documents(spark, sf_dir)
    hits = R.keyword_search(docs, WORDS, 20).select("doc_id", "score").join(docs, "doc_id")
    return K.result_rows(hits).select("snippet", "document.id", "document.title", "document.category", "score")


_CONTEXT = K.CONTEXT.replace("\n", "' || chr(10) || '").split("{}")


@query(f"""
WITH a AS (SELECT c.conv_id, 'what about ' || c.conv_id AS question, d.text AS context FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0) c JOIN documents d ON d.doc_id = c.conv_id),
r AS (SELECT conv_id, turn, role, text FROM conversations SEMI JOIN a USING (conv_id) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6),
p AS (
    SELECT conv_id, 0 AS part, 0 AS turn, 'system' AS role, 'Answer.' AS text FROM a UNION ALL SELECT conv_id, 1, turn, role, text FROM r
    UNION ALL SELECT conv_id, 2, 0, 'system', '{_CONTEXT[0]}' || substr(context, 1, 4000) || '{_CONTEXT[1]}' FROM a WHERE trim(context) <> ''
    UNION ALL SELECT conv_id, 3, 0, 'user', question FROM a
)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) - 1 AS INTEGER) AS n, role, text FROM p""")
def built_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every second conversation, with the document of its number as what was found."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("conv_id"), F.col("content").alias("context"))
    asked = messages(spark, sf_dir).select("conv_id").distinct().filter("conv_id % 2 = 0").join(docs, "conv_id").withColumn("question", F.concat(F.lit("what about "), F.col("conv_id").cast("string")))
    return K.built_messages(messages(spark, sf_dir), asked, "Answer.", 3)


def _matched_sql(rule: I.Rule) -> str:
    tests = [f"CASE WHEN contains(t, '{k.lower()}') THEN 'kw:{k}' END" for k in rule.keywords] + [f"CASE WHEN regexp_matches(t, '{p}') THEN 'pat:{p[:30]}' END" for p in rule.patterns]
    return f"array_to_string(list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL), ' ')"


@query(f"""
WITH q AS (SELECT conv_id, turn, regexp_replace(lower(trim(substr(text, 1, {I.LONGEST}))), '\\s+', ' ', 'g') AS t FROM conversations)
SELECT conv_id, turn, {_matched_sql(I.GREETING)} AS greeting, {_matched_sql(I.CHITCHAT)} AS chat FROM q""")
def intent_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keywords and patterns of two rules that each message holds."""
    told = messages(spark, sf_dir).withColumn("_t", normalise(F.substring("text", 1, I.LONGEST)))
    return told.select("conv_id", "turn", *(F.array_join(r.matched(F.col("_t")), " ").alias(n) for n, r in (("greeting", I.GREETING), ("chat", I.CHITCHAT))))


_MARKED = "'<null>' || substr(text, 1, 9) || '[object Object]' || substr(text, 10) || '<undefined><nul' || '[object x'"


@query(rf"SELECT conv_id || '-' || turn AS task_id, regexp_replace({_MARKED}, '\[object\s+\w+\]|<undefined>|<null>|<empty>', '', 'g') AS text FROM conversations")
def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with placeholders, streamed in pieces of seven characters and put together again."""
    rows = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/[c]onversations.parquet")
    marked = F.concat(F.lit("<null>"), F.substring("text", 1, 9), F.lit("[object Object]"), F.expr("substr(text, 10)"), F.lit("<undefined><nul[object x"))
    whole = rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("task_id"), marked.alias("text"))
    count = F.ceil(F.length("text") / 7).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr("text", 7 * i + 1, F.lit(7)))
    pieces = whole.select("task_id", count.alias("_n"), F.posexplode(cut).alias("seq", "piece")).select("task_id", F.col("seq").cast("long").alias("seq"), "piece", (F.col("seq") == F.col("_n") - 1).alias("done"))
    folder = f"{shared_folder(spark)}/clean-{uuid.uuid4().hex}"
    clean_stream(pieces).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(f"{folder}/out")
    return kept.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("text"))


@query(f"SELECT kb_id, count(*) AS n_chunks, CAST(sum(length(c.text)) AS BIGINT) AS n_chars FROM ({FIXED_SQL}) c JOIN (SELECT doc_id, lang AS kb_id FROM documents) USING (doc_id) WHERE contains(lower(c.text), 'the') GROUP BY kb_id")
def chained_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, those with a word, and their sums by base, as stages of a chain; of a second run nothing is left to do."""
    stages = [
        ("chunk", lambda d: d.select("kb_id", F.explode(C.fixed(F.col("content"))).alias("text"))),
        ("hold the word", lambda d: d.filter(F.lower("text").contains("the"))),
        ("sum up", lambda d: d.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))),
    ]
    chain = Chain(spark, f"{shared_folder(spark)}/chain-{uuid.uuid4().hex}", "documents", stages)
    chain.run(documents(spark, sf_dir))
    return chain.run(documents(spark, sf_dir))
