"""Conversations: memory windows, topics, follow-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.intent import follow_up
from loreweave.functions.text import strip

# Fixed values.
NOT_FOUND = ("暂未找到", "未找到", "没有找到", "知识库中暂未", "未提供", "抱歉", "没找到", "建议换个", "建议重新")
TOO_GENERAL = ("你好", "hi", "hello", "在吗", "帮助", "help")


def memory_window(messages: DataFrame, k: int = 6) -> DataFrame:
    """The last 2 k messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2 * k).drop("_r")


def synced_memory(messages: DataFrame, context: DataFrame, k: int = 6) -> DataFrame:
    """messages and, for conversations without any, the last 2 k user and assistant messages of the context."""
    told = context.filter(F.col("role").isin("user", "assistant"))
    return messages.unionByName(memory_window(told.join(messages.select("conv_id").distinct(), "conv_id", "left_anti"), k))


def with_topic(messages: DataFrame, least: int = 4) -> DataFrame:
    """messages with topic: the user's last usable text before, and has_history."""
    text = strip(F.coalesce("text", F.lit("")))
    usable = (F.col("role") == "user") & (F.length(text) >= least) & ~text.rlike("|".join(NOT_FOUND)) & ~text.isin(list(TOO_GENERAL))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("topic", F.coalesce(F.last(F.when(usable, text), ignorenulls=True).over(before), F.lit(""))).withColumn("has_history", F.count(F.lit(1)).over(before) > 0)


def long_topic(messages: DataFrame) -> DataFrame:
    """conv_id, topic: the last user text of more than 15 characters."""
    return messages.filter((F.col("role") == "user") & (F.length("text") > 15)).groupBy("conv_id").agg(F.max_by("text", "turn").alias("topic"))


def expanded_queries(messages: DataFrame) -> DataFrame:
    """The user's messages; follow-ups behind their topic."""
    rows = with_topic(messages).filter("role = 'user'")
    rows = rows.withColumn("is_follow_up", follow_up(F.col("text"), F.col("has_history")))
    return rows.withColumn("query", F.when(F.col("is_follow_up") & (F.col("topic") != ""), F.concat_ws(" ", "topic", "text")).otherwise(F.col("text")))


def exchanges(messages: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: a user's message and the assistant's that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = messages.withColumn("_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return pairs.filter("role = 'user' AND _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def prompt(messages: DataFrame, system: str, last: int = 6) -> DataFrame:
    """conv_id, prompt: the system's text and the last messages, one to a line."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return recent.groupBy("conv_id").agg(F.concat_ws("\n", F.lit(system), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("prompt"))


def hot_questions(messages: DataFrame, n: int = 10) -> DataFrame:
    asked = messages.filter("role = 'user'").groupBy(F.lower(strip(F.col("text"))).alias("question")).agg(F.count(F.lit(1)).alias("n"))
    return asked.orderBy(F.desc("n"), "question").limit(n)
