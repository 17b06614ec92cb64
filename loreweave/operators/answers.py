"""Answers without a model, and the seams where models can be plugged in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.vectors import hash_embedding

# Markers of an answer that found nothing.
NOT_FOUND = ("暂未找到", "未找到", "没有找到", "抱歉")


class Embedder(Protocol):
    """Vectors of texts; documents and queries may be encoded differently."""

    dimension: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...

    def encode_query(self, texts: list[str]) -> list[list[float]]: ...


#: Makers of embedders by name; one is made in each task. The hash embedding needs none.
EMBEDDERS: dict[str, Callable[[], Embedder]] = {}


def embed(docs: DataFrame, key: str, text: str, provider: str = "hash", query: bool = False) -> DataFrame:
    """Cells (key, idx, weight) of the hash embedding, or key and embedding of a plugged-in one."""
    if provider == "hash":
        return hash_embedding(docs, key, text)
    if provider not in EMBEDDERS:
        raise ValueError(f"no embedder {provider}")
    make = EMBEDDERS[provider]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            texts = b["t"].fillna("").tolist()
            yield pd.DataFrame({key: b[key], "embedding": model.encode_query(texts) if query else model.encode(texts)})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, embedding array<double>")


def extractive_answer(hits: DataFrame, n: int = 3) -> DataFrame:
    """query_id, answer, confidence: the first n snippets of the hits (rank from 1), and the first one's score."""
    first = hits.filter(F.col("rank") <= n).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "snippet", "score"))).alias("_h"))
    return first.select("query_id", F.array_join(F.transform("_h", lambda h: h["snippet"]), "\n").alias("answer"), F.get(F.col("_h"), 0)["score"].alias("confidence"))


def final_answer(answer: Column, n_citations: Column, faq: Column) -> Column:
    """A plain sentence for answers that found nothing, unless there are citations or it is a question on the system."""
    lost = answer.rlike("|".join(NOT_FOUND)) | (F.trim(answer) == "")
    return F.when(lost & (n_citations == 0) & ~faq, F.lit(f"知识库中{NOT_FOUND[0]}相关内容")).otherwise(answer)


# What an answer says that found nothing, or that contradicts itself, and the least score of a hit that was worth reading.
NOTHING_FOUND = ("知识库中暂未找到", "知识库中暂未", "知识库中未找到", "知识库中没有找到")
ASK_AGAIN = ("换个问法", "换种问法", "换个问题", "建议重新提问")
WORTH_READING = 0.30


def outcome(answer: Column, n_worth: Column) -> Column:
    """'kept', 'no_definition' or 'no_match' of an answer, given how many hits were worth reading.

    An answer that found nothing or contradicts itself, without a citation, had
    hits that don't define what was asked, or none. One that found nothing and
    cites all the same found nothing. Only a kept answer and 'no_definition' keep their citations.
    """
    says = lambda words: reduce(lambda a, b: a | b, (answer.contains(w) for w in words))
    nothing, again, cites = says(NOTHING_FOUND), says(ASK_AGAIN), answer.rlike("[①-⑳]")
    lost = F.when(n_worth > 0, "no_definition").otherwise("no_match")
    return F.when((nothing | again) & ~cites, lost).when(nothing & cites, "no_match").otherwise("kept")


# Words of a question that don't tell what it is about, words for the system itself, and titles of texts on it.
FAQ_STOPS = ("的", "了", "和", "是", "在", "我", "有", "都", "一", "上", "也", "很", "到", "说", "要", "去", "你", "介绍", "什么", "如何", "怎么", "怎样", "一下", "请", "帮")
FAQ_SYSTEM = (
    "本平台", "本系统", "本知识库", "这个系统", "该系统", "这套系统", "知识库", "平台", "工具", "应用", "软件", "产品", "知识", "能力", "使用", "功能", "介绍", "使用方式", "使用说明", "使用手册",
)
FAQ_TITLES = ("知识库介绍", "使用方式", "知识库使用方式", "本知识库介绍")


def faq_override(question: str, hits: DataFrame, faqs: DataFrame) -> DataFrame:
    """id, title, content, source of what answers a question on the system: the faqs, or hits if they don't fit it.

    Both tables have id, title, content. The faqs give way where there are hits and
    the question has words, none of which occurs in a faq, or none of which is a word
    for the system while all faqs are about it.
    """
    words = sorted({w for w in (m.lower() for m in re.findall("[一-鿿]+|[A-Za-z]+", question)) if len(w) >= 2 and w not in FAQ_STOPS})
    text = F.lower(F.concat_ws("\n", "title", "content"))
    found = reduce(lambda a, b: a | b, (text.contains(w) for w in words), F.lit(False))
    told = faqs.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.bool_and(F.col("title").isin(*FAQ_TITLES)), F.lit(True)).alias("_intro"), F.coalesce(F.bool_or(found), F.lit(False)).alias("_found"))
    had = hits.select("id").limit(1).agg(F.count(F.lit(1)).alias("_hits"))
    flag = told.join(F.broadcast(had))  # one row
    off_topic = F.lit(bool(words)) & ((F.lit(not set(words) & set(FAQ_SYSTEM)) & F.col("_intro")) | ~F.col("_found"))
    flag = flag.select(((F.col("_hits") > 0) & (F.col("_n") > 0) & off_topic).alias("_through"))
    rows = lambda df, source: df.select("id", "title", "content", F.lit(source).alias("source")).join(F.broadcast(flag))
    return rows(hits, "search").filter("_through").unionByName(rows(faqs, "faq").filter("NOT _through")).drop("_through")
