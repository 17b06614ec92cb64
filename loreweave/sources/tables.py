"""The driver's tables, and the entities that the engine sees in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, category, kb_id, content."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("category"), F.col("lang").alias("kb_id"), F.col("text").alias("content"))


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, if a small table comes in fewer partitions than those; a large one stays as it is read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, category (the label), embedding as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("category"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit records: id, ts (TIMESTAMP), username, action, value, k."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("username"), F.col("event_type").alias("action"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
