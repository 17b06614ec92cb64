"""Streams over files: audit counts, event windows, ingest and token texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files below a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_time(events: DataFrame, late: str = "1 day") -> DataFrame:
    """events with ts as TIMESTAMP and a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def action_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def windowed(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Events to a window and type; without slide the windows follow on each other."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user that end with a gap."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, mode: str, folder: str, key: list[str] | None = None) -> DataFrame:
    """Read all that is there and give the result, which executors write below folder batch by batch.

    In complete mode the last batch holds the whole result; in update mode the
    last row of each key counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    read = stream.sparkSession.read
    if key is None:
        return read.schema(stream.schema).parquet(f"{folder}/out/batch={query.lastProgress['batchId']}")
    rows = read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/*")
    rest = [c for c in rows.columns if c not in key and c != "batch"]
    return rows.groupBy(*key).agg(*(F.max_by(c, "batch").alias(c) for c in rest))


def ingest(documents: DataFrame, chunks: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Chunk arriving documents and append them to path; a batch that is tried again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        chunks(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def assembled(tokens: DataFrame) -> DataFrame:
    """task_id, text, done: the text that a task's tokens (task_id, seq, piece, done) make up so far.

    Tokens are kept as rows by ingest and put in order when they are read, so late
    ones come to their place and no state grows with a text. Of tokens of equal
    seq the least piece counts, which also covers tokens that were sent again.
    """
    once = tokens.groupBy("task_id", "seq").agg(F.min("piece").alias("piece"), F.bool_or("done").alias("done"))
    pieces = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    made = once.groupBy("task_id").agg(pieces.alias("_p"), F.coalesce(F.bool_or("done"), F.lit(False)).alias("done"))
    return made.select("task_id", F.array_join(F.transform("_p", lambda p: F.coalesce(p["piece"], F.lit(""))), "").alias("text"), "done")


#: What a hybrid search reports on its way: percent and stage.
SEARCH_STAGES = ((5, "start"), (10, "vector"), (30, "vector done"), (40, "graph"), (65, "graph done"), (75, "keyword"), (90, "keyword done"), (100, "done"))


def answer_events(tokens: DataFrame, sources: DataFrame) -> DataFrame:
    """task_id, n, kind, payload: the events of streamed answers in order.

    'metadata' with the number of sources (task_id, n_sources) comes first, then a
    'text' for each token, and 'done', or 'error' for a task whose last token hasn't come.
    """
    first = sources.select("task_id", F.lit(-1).cast("long").alias("n"), F.lit("metadata").alias("kind"), F.col("n_sources").cast("string").alias("payload"))
    text = tokens.select("task_id", F.col("seq").cast("long").alias("n"), F.lit("text").alias("kind"), F.col("piece").alias("payload"))
    last = tokens.groupBy("task_id").agg((F.max("seq") + 1).cast("long").alias("n"), F.coalesce(F.bool_or("done"), F.lit(False)).alias("_d"))
    return first.unionByName(text).unionByName(last.select("task_id", "n", F.when(F.col("_d"), "done").otherwise("error").alias("kind"), F.lit("").alias("payload")))


def migration_events(moved: DataFrame) -> DataFrame:
    """batch, doc_id, done, total, percent: one event for each document (batch, place, doc_id) of a migration, in the order of their places."""
    own = Window.partitionBy("batch")
    done, total = F.row_number().over(own.orderBy("place")), F.count(F.lit(1)).over(own)
    return moved.select("batch", "doc_id", done.alias("done"), total.alias("total")).withColumn("percent", F.floor(100 * F.col("done") / F.col("total")).cast("int"))
