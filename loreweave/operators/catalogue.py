"""Look-ups and projections: permissions, roles, tags, bases, single chunks, results and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.functions.text import tag_name

from .lifecycle import permissions
from .sessions import memory_window

# The dimensions of tags (name, label, color, description), the permissions of roles, and how roles are shown.
TAG_DIMENSIONS = (
    ("topic", "主题", "blue", "技术主题 / 业务领域"),
    ("type", "类型", "green", "文档类型（教程/手册/规范/参考）"),
    ("level", "难度", "amber", "入门/进阶/专家"),
    ("language", "语言", "purple", "中文/英文/双语"),
    ("custom", "自定义", "gray", "用户自定义标签"),
)
EDITOR = ("doc:read", "doc:write", "kb:read", "kb:write", "ai:ask", "ai:stream", "graph:read", "graph:write", "chunk:read", "chunk:write", "settings:read")
VIEWER = ("doc:read", "kb:read", "ai:ask", "ai:stream", "graph:read", "chunk:read", "settings:read")
ADMIN = ("doc:read", "doc:write", "doc:delete", "kb:read", "kb:write", "kb:delete", "ai:ask", "ai:stream", "graph:read", "graph:write", "chunk:read", "chunk:write", "user:read", "user:write", "settings:read", "settings:write")
ROLES = (("admin", "管理员", "red", "全部权限", ADMIN), ("editor", "编辑者", "blue", "内容管理", EDITOR), ("viewer", "访客", "gray", "只读 + AI", VIEWER))
CONTEXT = "【知识库参考内容】\n{}\n\n请基于以上知识库内容回答用户的最新问题。"
UNTITLED, UNCATEGORISED = "未知文档", "默认"
#: Characters of a prompt's context, and of a result's snippet.
CONTEXT_CHARS, SNIPPET_CHARS = 4000, 500


def tag_dimensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAG_DIMENSIONS), "name string, label string, color string, description string")


def roles(spark: SparkSession) -> DataFrame:
    """role, label, color, description, permissions."""
    return spark.createDataFrame(list(ROLES), "role string, label string, color string, description string, permissions array<string>")


def with_any_permission(users: DataFrame, wanted: list[str], known: DataFrame | None = None) -> DataFrame:
    """user_id, allowed for each user (user_id, roles): whether a role has any of the wanted permissions; an admin has all, also of an empty list."""
    granted = permissions(users, (known if known is not None else roles(users.sparkSession)).select("role", "permissions"))
    any_ = F.arrays_overlap("permissions", F.array(*map(F.lit, wanted)).cast("array<string>")) | F.array_contains("permissions", "*")
    return users.select("user_id").distinct().join(granted, "user_id", "left").select("user_id", F.coalesce(any_, F.lit(False)).alias("allowed"))


def tag_of(tags: DataFrame, name: str) -> DataFrame:
    """The tag of a name, whatever its case and the blanks around it."""
    return tags.filter(F.col("tag") == tag_name(F.lit(name)))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """tag, label, color, doc_count of a file that holds one object, tags by their names; a file that is none has no tags."""
    held = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string, struct<label:string,color:string,doc_count:long>>")).alias("tag", "t"))
    return held.select("tag", "t.label", "t.color", F.coalesce("t.doc_count", F.lit(0)).alias("doc_count"))


def write_tags(tags: DataFrame, path: str) -> None:
    """One object of all tags, a dictionary that users keep by hand."""
    entry = F.struct("tag", F.struct("label", "color", "doc_count").alias("t"))
    tags.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value")).write.mode("overwrite").text(path)


def base_of(bases: DataFrame, base_id: str) -> DataFrame:
    return bases.filter(F.col("id") == base_id)


def chunk_of(chunks: DataFrame, doc_id: int, chunk_id: str) -> DataFrame:
    """The chunk of an id, if it is the document's."""
    return chunks.filter((F.col("doc_id") == doc_id) & (F.col("chunk_id") == chunk_id))


def plain_metadata(metadata: Column, lists: Column) -> Column:
    """One map of texts of a map of texts and one of lists, which are joined by commas; what is null is left out."""
    kept = F.map_filter(metadata, lambda _, v: v.isNotNull())
    joined = F.transform_values(F.map_filter(lists, lambda _, v: v.isNotNull()), lambda _, v: F.array_join(v, ",", "None"))
    return F.map_concat(F.map_filter(kept, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(joined), k), F.lit(False))), joined)


def result_rows(hits: DataFrame) -> DataFrame:
    """snippet, document (id, title, content, category), score of hits (doc_id, title, content, category, score)."""
    document = F.struct(F.col("doc_id").alias("id"), F.coalesce("title", F.lit(UNTITLED)).alias("title"), "content", F.coalesce("category", F.lit(UNCATEGORISED)).alias("category"))
    return hits.select(F.substring("content", 1, SNIPPET_CHARS).alias("snippet"), document.alias("document"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))


def built_messages(messages: DataFrame, asked: DataFrame, system: str, k: int = 6) -> DataFrame:
    """conv_id, n, role, text: what a model is given for a question (conv_id, question, context).

    The system's text first, then the conversation's last messages, what was found,
    cut to CONTEXT_CHARS and left out if it is blank, and the question.
    """
    recent = memory_window(messages, k).join(asked.select("conv_id"), "conv_id", "left_semi").select("conv_id", F.lit(1).alias("_part"), "turn", "role", "text")
    one = lambda part, role, text: asked.select("conv_id", F.lit(part).alias("_part"), F.lit(0).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    before, after = CONTEXT.split("{}")
    told = one(2, "system", F.when(F.trim(F.coalesce("context", F.lit(""))) != "", F.concat(F.lit(before), F.substring("context", 1, CONTEXT_CHARS), F.lit(after)))).filter("text IS NOT NULL")
    rows = one(0, "system", F.lit(system)).unionByName(recent.withColumn("turn", F.col("turn").cast("long"))).unionByName(told).unionByName(one(3, "user", F.col("question")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("_part", "turn")) - 1
    return rows.select("conv_id", place.alias("n"), "role", "text")
