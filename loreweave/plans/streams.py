"""Streams over the events, run once over what is there; the batch twin is the oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import cache
from loreweave.operators import chunking as C
from loreweave.sources.checkpoints import shared_folder
from loreweave.sources.tables import table
from loreweave.streaming import jobs as J

from .chunks import FIXED_SQL
from .registry import query


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream. A pattern as the path fits a single file as well as a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def _finished(spark: SparkSession, stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    return J.run_once(stream, mode, _folder(spark), key)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_audit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(spark, J.action_counts(_stream(spark, sf_dir, "events")), "complete")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _finished(spark, J.windowed(J.event_time(_stream(spark, sf_dir, "events")), "1 hour"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type FROM events) GROUP BY ALL")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _finished(spark, J.windowed(J.event_time(_stream(spark, sf_dir, "events")), "1 hour", "30 minutes"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions over the events as a batch; a stream closes them by its watermark."""
    out = J.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query(f"SELECT doc_id, count(*) AS n FROM ({FIXED_SQL}) GROUP BY doc_id")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    cut = lambda b: C.exploded(b, "doc_id", C.fixed(F.col("text")))
    J.ingest(_stream(spark, sf_dir, "documents"), cut, f"{folder}/chunks", f"{folder}/state")
    return spark.read.parquet(f"{folder}/chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id AS task_id, string_agg(text, '' ORDER BY turn) AS text, true AS done FROM conversations GROUP BY conv_id")
def stream_token_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    J.ingest(_stream(spark, sf_dir, "conversations"), _tokens, f"{folder}/tokens", f"{folder}/state")
    return J.assembled(spark.read.parquet(f"{folder}/tokens"))


def _tokens(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("seq"), F.col("text").alias("piece"), F.lit(True).alias("done"))


@query("""
WITH s AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id AS task_id, -1 AS n, 'metadata' AS kind, CAST(n AS VARCHAR) AS payload FROM s
UNION ALL SELECT conv_id, turn, 'text', text FROM conversations
UNION ALL SELECT conv_id, max(turn) + 1, CASE WHEN conv_id % 3 = 0 THEN 'error' ELSE 'done' END, '' FROM conversations GROUP BY conv_id""")
def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third conversation breaks off."""
    turns = table(spark, sf_dir, "conversations")
    sources = turns.filter("role = 'user'").groupBy(F.col("conv_id").alias("task_id")).agg(F.count(F.lit(1)).alias("n_sources"))
    return J.answer_events(_tokens(turns).withColumn("done", F.col("task_id") % 3 != 0), sources)


@query("SELECT CAST(o_custkey AS BIGINT) AS batch, o_orderkey AS doc_id, CAST(row_number() OVER w AS INTEGER) AS done, count(*) OVER (PARTITION BY o_custkey) AS total, CAST(floor(100 * row_number() OVER w / count(*) OVER (PARTITION BY o_custkey)) AS INTEGER) AS percent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def migration_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the documents of a migration."""
    return J.migration_events(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("place"), F.col("o_orderkey").alias("doc_id")))


@query("SELECT conv_id, percent, stage FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user'), (VALUES (5, 'start'), (10, 'vector'), (30, 'vector done'), (40, 'graph'), (65, 'graph done'), (75, 'keyword'), (90, 'keyword done'), (100, 'done')) t(percent, stage)")
def search_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the search for each conversation's questions reports on its way."""
    stages = F.array(*(F.struct(F.lit(p).alias("percent"), F.lit(s).alias("stage")) for p, s in J.SEARCH_STAGES))
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id").distinct().select("conv_id", F.inline(stages))


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, n, s AS stored, false AS hit FROM e WHERE n = 1
    UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN e.s - r.stored <= 300 THEN r.stored ELSE e.s END, e.s - r.stored <= 300 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT count(*) AS requests, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / greatest(count(*), 1), 4) AS rate FROM r""")
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return cache.hit_rate(cache.cache_replay(requests, F.col("user_id"), most=None))


_SIZES = (1, 10, 100)


@query("""
WITH RECURSIVE q AS (SELECT event_id, user_id, epoch_us(ts) AS s, row_number() OVER (ORDER BY ts, event_id) AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT *, lag(g) OVER (PARTITION BY user_id ORDER BY g) AS pg FROM q),
d AS (SELECT i.user_id, i.s, i.n, i.pg, count(r.g) AS distance FROM p i LEFT JOIN p r ON r.g > i.pg AND r.g < i.g AND (r.pg IS NULL OR r.pg < i.pg) GROUP BY ALL),
e AS (SELECT d.*, size, d.pg IS NULL OR distance >= size AS absent FROM d, (VALUES (1), (10), (100)) t(size)),
r AS (SELECT size, user_id, n, s AS stored, false AS hit FROM e WHERE n = 1
    UNION ALL SELECT e.size, e.user_id, e.n, CASE WHEN e.absent OR e.s - r.stored > 86400000000 THEN e.s ELSE r.stored END, NOT (e.absent OR e.s - r.stored > 86400000000)
    FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1 AND e.size = r.size)
SELECT CAST(size AS INTEGER) AS most, user_id, count(*) AS requests, count(*) FILTER (hit) AS hits FROM r GROUP BY size, user_id""")
def cache_replay_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each user in caches of three sizes, of which every entry lives a day."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id")
    found = None
    for most in _SIZES:
        replayed = cache.cache_replay(events, F.col("user_id"), 86_400, most).withColumn("most", F.lit(most))
        found = replayed if found is None else found.unionByName(replayed)
    return found.join(events.select("id", "user_id"), "id").groupBy("most", "user_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"))
