"""Vector, keyword and fused retrieval for a batch of queries.

A batch of queries is a small table that the caller states, so it is broadcast
and every document or vector is read once. Top-k cuts are row_number() filters,
which Spark applies before the shuffle as well as after it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import bind, occurrences

# The limits and weights of retrieval.
LEAST_SCORE, BELOW_TOP, RRF_K, UNSCORED = 0.20, 0.06, 60, 0.5
STOP_WORDS = (
    "的", "了", "和", "是", "在", "我", "有", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己",
    "这", "那", "什么", "如何", "怎么", "怎样", "为什么", "哪", "哪些", "那个", "这个", "吗",
)
COMPLETE = ("什么是", "什么叫", "如何", "怎么", "为什么", "介绍")
SYNONYMS = {
    "怎么用": ("如何使用", "怎么使用", "使用方式", "用法", "怎么操作"),
    "是什么": ("什么是", "什么叫", "定义", "概念"),
    "区别": ("差异", "不同", "对比", "比较"),
    "智能体": ("Agent", "agent", "AI agent", "智能代理"),
    "提示词": ("prompt", "Prompt", "系统提示", "指令"),
    "大模型": ("LLM", "llm", "大语言模型"),
    "知识图谱": ("图谱", "知识网络", "KG"),
}
#: Bytes of query vectors that are broadcast at a time, and scores that a task holds at once.
BLOCK_BYTES, SCORES = 32 << 20, 2_000_000


def ranked(df: DataFrame, keys: list[str], score: str, tie: str | list[str], k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each key with their rank from 1; ties go to the lower tie."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *([tie] if isinstance(tie, str) else tie))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def matches(categories: list[str] | None = None, kb_id: str | None = None) -> Column:
    """The predicate on documents or chunks; 'all' and None don't filter."""
    p = F.lit(True)
    if categories:
        p = p & F.col("category").isin(categories)
    if kb_id and kb_id != "all":
        p = p & (F.col("kb_id") == kb_id)
    return p


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest vectors of each query by cosine, to six decimals and not below 0.

    queries: query_id, query (a vector); vectors: vec_id, embedding. Ids may be
    numbers or texts. Queries of each length meet the vectors of that length, as
    in a store with a collection for each dimension. They are taken block by
    block of BLOCK_BYTES; a block is broadcast as a matrix of unit vectors, and a
    task keeps the best k of each query while it multiplies its vectors with it.
    A vector without values or null is no query and no neighbour, a zero vector is at 0 from
    all. Ties go to the lower vec_id.
    """
    sizes = queries.groupBy(F.size("query").alias("dim")).agg(F.count(F.lit(1)).alias("n")).filter("dim > 0").orderBy("dim").collect()
    found = []
    for dim, n in sizes or [(1, 0)]:
        own, blocks = queries.filter(F.size("query") == dim), max(1, -(-n * 8 * dim // BLOCK_BYTES))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        found += [_nearest(own.filter(block == b) if blocks > 1 else own, vectors, k, dim) for b in range(blocks)]
    return ranked(reduce(DataFrame.unionByName, found), ["query_id"], "score", "vec_id", k)


def _ids(values: list) -> np.ndarray:
    """Numbers as longs; other ids as texts, which numpy orders as Spark does."""
    return np.array(values, np.int64 if all(isinstance(v, (int, np.integer)) for v in values) else np.str_)


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, dim: int) -> DataFrame:
    """query_id, vec_id, score of the k nearest in each task, for a block of queries of one length."""
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "vec_id"))}
    rows = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).collect()  # at most BLOCK_BYTES
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
    asked = np.array([r["query_id"] for r in rows], object)
    shared = queries.sparkSession.sparkContext.broadcast(unit(np.array([r["query"] for r in rows], np.float64).reshape(-1, dim)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = shared.value
        n = len(matrix)
        ids, scores = None, np.empty((n, 0))
        for batch in batches:
            step = max(1, SCORES // max(n, 1))
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                near = np.maximum(np.round(matrix @ unit(np.stack(part["embedding"].to_numpy())).T, 6), 0.0)
                own = np.broadcast_to(_ids(part["vec_id"].tolist()), near.shape)
                ids = own if ids is None else np.concatenate((ids, own), axis=1)
                scores = np.concatenate((scores, near), axis=1)
                order = np.lexsort((ids, -scores), axis=1)[:, :k]
                ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
        if n and ids is not None:
            yield pd.DataFrame({"query_id": np.repeat(asked, ids.shape[1]), "vec_id": ids.reshape(-1), "score": scores.reshape(-1)})

    usable = vectors.filter((F.size("embedding") == dim) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return usable.mapInPandas(run, f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double")


def vector_top_k_then_filter(queries: DataFrame, vectors: DataFrame, keep: Column, k: int) -> DataFrame:
    """The filter is applied to the best 3 k only, so less than k may stay."""
    best = vector_top_k(queries, vectors, 3 * k).join(vectors.drop("embedding"), "vec_id").filter(keep).drop("rank")
    return ranked(best, ["query_id"], "score", "vec_id", k).select("query_id", "vec_id", "score", "rank")


def above_threshold(hits: DataFrame) -> DataFrame:
    """Hits that score near their query's best one."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("_top", top).filter(F.col("score") >= F.greatest(F.lit(LEAST_SCORE), F.round(F.col("_top") - BELOW_TOP, 6))).drop("_top")


def keywords_of(query: str) -> list[str]:
    """The words of a query between white space and commas; repeated ones count again."""
    return [w for w in re.split(r"[\s,，、]+", query.lower().strip()) if w]


def keyword_search(docs: DataFrame, query: str, k: int = 5, keep: Column | None = None) -> DataFrame:
    """doc_id, hits, occurrences, score, snippet of documents that hold a keyword, best first."""
    words = keywords_of(query)
    if not words:
        return docs.limit(0).select("doc_id", F.lit(0).alias("hits"), F.lit(0).alias("occurrences"), F.lit(0.0).alias("score"), F.lit("").alias("snippet"))
    text = F.lower(F.coalesce("content", F.lit("")))

    def told(t: Column) -> Column:
        first = lambda n: F.coalesce(*(F.when(F.get(n, k) > 0, F.instr(t, F.lit(w))) for k, w in enumerate(words)))
        return bind(F.array(*(occurrences(t, F.lit(w)) for w in words)), lambda n: F.struct(n.alias("times"), (first(n) - 1).alias("first")))

    out = docs.filter(keep) if keep is not None else docs
    # A text is lowered once; what is exploded isn't computed anew by each expression.
    out = out.select("doc_id", F.explode(F.array(bind(text, told))).alias("_t"), "content")
    hits, times = F.size(F.filter("_t.times", lambda n: n > 0)), F.aggregate("_t.times", F.lit(0), lambda s, n: s + n)
    out = out.select("doc_id", hits.alias("hits"), times.alias("occurrences"), F.col("_t.first").alias("_first"), "content").filter("hits > 0")
    score = F.least(F.lit(0.95), F.round(F.lit(0.4) + F.col("hits") * 0.15 + F.least("occurrences", F.lit(10)) * 0.03, 6))
    start = F.greatest(F.lit(0), F.col("_first") - 300)
    return out.select("doc_id", "hits", "occurrences", score.alias("score"), F.substr("content", start + 1, F.col("_first") + 500 - start).alias("snippet")).orderBy(F.desc("score"), "doc_id").limit(k)


def simple_search(docs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """1 for documents that hold the query, else the share of its words that they hold."""
    q = query.lower()
    words = sorted(set(q.split()))
    text = F.lower("content")
    own = F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    share = F.size(F.array_intersect(own, F.array(*map(F.lit, words)))) / F.lit(float(len(words)))
    scored = docs.select("doc_id", F.when(text.contains(q), 1.0).otherwise(F.round(share, 6)).alias("score"), F.greatest(F.instr(text, F.lit(q)) - 51, F.lit(0)).alias("_at"), "content")
    return scored.filter("score > 0").select("doc_id", "score", F.substr("content", F.col("_at") + 1, F.lit(200)).alias("snippet")).orderBy(F.desc("score"), "doc_id").limit(k)


def term_rank(docs: DataFrame, term: str, k: int = 10) -> DataFrame:
    """Occurrences of a term to a word of the text."""
    text = F.lower("content")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    scored = docs.select("doc_id", occurrences(text, F.lit(term.lower())).alias("occurrences"), words.alias("words")).filter("occurrences > 0")
    return scored.withColumn("score", F.round(F.col("occurrences") / F.greatest("words", F.lit(1)), 6)).orderBy(F.desc("score"), "doc_id").limit(k)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """query_id, doc_id, rrf_score, vector_score, keyword_score by reciprocal ranks; ranks count from 1."""
    columns = ["query_id", "doc_id", "rank", "vector_score", "keyword_score"]
    none = F.lit(None).cast("double")
    both = vector_hits.withColumn("vector_score", F.col("score")).withColumn("keyword_score", none).select(columns).unionByName(keyword_hits.withColumn("vector_score", none).withColumn("keyword_score", F.col("score")).select(columns))
    return both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("rrf_score"), F.max("vector_score").alias("vector_score"), F.max("keyword_score").alias("keyword_score"))


def display_score(vector: Column, keyword: Column | None = None) -> Column:
    """The score to show: the vector's, and for keyword hits without one a constant."""
    return F.coalesce(F.nullif(vector, F.lit(0.0)), *([F.nullif(keyword, F.lit(0.0))] if keyword is not None else []), F.lit(UNSCORED))


def length_factor(n: Column) -> Column:
    """Up to a tenth more for longer texts; none for very short and very long ones."""
    return F.when((n >= 50) & (n <= 5000), 1.0 + F.least(F.lit(0.1), (n - 50) / 2000.0 * 0.1)).otherwise(1.0)


def terms_of(query: str) -> list[str]:
    """ASCII words and Chinese n-grams without stop words, of the query before any variant."""
    query = query.split(" ||| ")[0]
    chinese = re.sub("[^一-鿿]", "", query)
    grams = {chinese[i : i + n] for n in (1, 2, 3) for i in range(len(chinese) - n + 1)}
    return sorted({g for g in grams if not set(g) & set(STOP_WORDS)} | {w.lower() for w in re.findall("[A-Za-z]+", query) if len(w) > 1 and w.lower() not in STOP_WORDS})


def covered(hits: DataFrame, query: str, keep_at_least: int = 3) -> DataFrame:
    """Hits whose content holds a term of the query, with their number; the first ones if none does. hits: rank, content."""
    terms = terms_of(query)
    if not terms:
        return hits.withColumn("keyword_hits", F.lit(0))
    text = F.lower("content")
    chinese = F.regexp_replace(text, "[^一-鿿]", "")
    found = [(text.contains(t) | chinese.contains(t)).cast("int") for t in terms]
    scored = hits.withColumn("keyword_hits", sum(found[1:], found[0]))
    scored = scored.withColumn("_most", F.max("keyword_hits").over(Window.partitionBy("query_id")))
    return scored.filter("keyword_hits > 0" + f" OR (_most = 0 AND rank <= {keep_at_least})").drop("_most")


def rewritten(query: str) -> list[str]:
    """The query and at most one variant with a synonym, unless it states its topic itself."""
    if any(p in query for p in COMPLETE):
        return [query]
    variants = [query.replace(a, b) for a, bs in SYNONYMS.items() if a in query for b in bs]
    return list(dict.fromkeys([query, *variants]))[:2]


def expanded(query: str) -> str:
    """Short queries that are a synonym's key get its variants."""
    return " | ".join([query, *SYNONYMS[query]]) if len(query) <= 10 and query in SYNONYMS else query


@dataclass(frozen=True)
class HybridConfig:
    top_k: int = 8
    categories: tuple[str, ...] = ()
    kb_id: str | None = None
    keywords: bool = True


#: Nodes of the graph that are added to a question's hits, and what stands between texts of one document.
GRAPH_HITS, GAP, KEYWORD_MARK = 5, "\n...\n", "[关键词命中]: "


def near_chunks(cells: DataFrame, asked: DataFrame, k: int, keep: DataFrame | None = None) -> DataFrame:
    """query_id (0), doc_id, chunk_index, score, rank of the k chunks nearest to one question, without those far below the best; of the documents in keep, if given.

    cells (doc_id, chunk_index, idx, weight) and asked (idx, weight) are hash
    embeddings. Only cells on the question's indices meet, by an equi-join with a
    side of one text, and a chunk's are summed before the shuffle.
    """
    dots = cells.join(F.broadcast(asked.select("idx", F.col("weight").alias("_q"))), "idx").groupBy("doc_id", "chunk_index").agg(F.round(F.sum(F.col("weight") * F.col("_q")), 6).alias("score"))
    if keep is not None:
        dots = dots.join(keep.select("doc_id").distinct(), "doc_id", "left_semi")
    best = ranked(dots.filter("score > 0").withColumn("query_id", F.lit(0)), ["query_id"], "score", ["doc_id", "chunk_index"], k)
    return above_threshold(best)


def fuse_chunks(near: DataFrame, words: DataFrame) -> DataFrame:
    """query_id, doc_id, rrf_score, vector_score, keyword_score, source, content: every hit of a document adds its reciprocal rank.

    near has query_id, doc_id, rank, score, text of chunks; words the same of documents,
    with text as snippet. content joins a document's texts in the order of their
    ranks, chunks first, without those that it holds already.
    """
    columns = ["query_id", "doc_id", "rank", "score", "text", "channel"]
    both = near.withColumn("channel", F.lit(0)).select(columns).unionByName(words.withColumn("text", F.col("snippet")).withColumn("channel", F.lit(1)).select(columns))
    of = lambda c: F.when(F.col("channel") == c, F.col("score"))
    hits = F.array_sort(F.collect_list(F.struct("channel", "rank", "text")))
    fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("rrf_score"), F.max(of(0)).alias("vector_score"), F.max(of(1)).alias("keyword_score"), hits.alias("_h"))
    mark = lambda h: F.when(h["channel"] == 1, KEYWORD_MARK).otherwise("")
    add = lambda text, h: F.when(text.contains(h["text"]), text).otherwise(F.concat(text, F.lit(GAP), mark(h), h["text"]))
    content = F.aggregate(F.slice("_h", 2, F.size("_h")), F.get("_h", 0)["text"], add)
    source = F.when(F.col("vector_score").isNull(), "keyword").when(F.col("keyword_score").isNull(), "vector").otherwise("hybrid")
    return fused.select("query_id", "doc_id", "rrf_score", "vector_score", "keyword_score", source.alias("source"), content.alias("content"))


def graph_hits(reached: DataFrame, nodes: DataFrame, n: int = GRAPH_HITS) -> DataFrame:
    """The first n nodes that a question reaches in the graph, as hits without a score of their own. reached: id, distance."""
    first = reached.join(nodes.select("id", "name", "type"), "id").orderBy("distance", "id").limit(n)
    none = F.lit(None)
    content = F.concat(F.lit("实体: "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(")"))
    return first.select(F.lit(0).alias("query_id"), F.col("id"), none.cast("double").alias("rrf_score"), none.cast("double").alias("vector_score"), none.cast("double").alias("keyword_score"), F.lit("graph").alias("source"), content.alias("content"))


def hybrid(docs: DataFrame, chunks: DataFrame | Callable[[DataFrame], DataFrame], near: Callable[[int, DataFrame | None], DataFrame], query: str, config: HybridConfig = HybridConfig(), graph: DataFrame | None = None) -> DataFrame:
    """id, rank, source, score, rrf_score, weighted, keyword_hits, content of what answers one question.

    chunks (doc_id, chunk_index, text) of docs, or what gives those of the documents of a few hits; near gives so many chunks nearest to
    the question, as near_chunks does, of some documents or of all. The vector
    channel gives 2 top_k chunks, the keyword channel 2 top_k documents; their fused top_k documents and the hits of graph
    (as graph_hits gives them) are weighted by length and must hold a term of the query.
    """
    docs = docs.filter(matches(list(config.categories), config.kb_id))
    some = bool(config.categories or (config.kb_id and config.kb_id != "all"))
    # The hits are a few rows, so the texts stay where they are.
    nearest = near(2 * config.top_k, docs.select("doc_id") if some else None)
    found = F.broadcast(nearest).join(chunks(nearest) if callable(chunks) else chunks, ["doc_id", "chunk_index"])
    words = ranked(keyword_search(docs, query, 2 * config.top_k).withColumn("query_id", F.lit(0)), ["query_id"], "score", "doc_id", 2 * config.top_k)
    fused = fuse_chunks(found, words if config.keywords else words.limit(0))
    hits = ranked(fused, ["query_id"], "rrf_score", "doc_id", config.top_k).drop("rank").withColumn("id", F.col("doc_id").cast("string")).drop("doc_id")
    if graph is not None:
        hits = hits.unionByName(graph)
    weighted = F.round(F.coalesce("rrf_score", F.lit(0.0)) * length_factor(F.length("content")), 9)
    hits = hits.withColumn("weighted", weighted)
    hits = covered(ranked(hits, ["query_id"], "weighted", "id", config.top_k + GRAPH_HITS), query)
    best = ranked(hits.drop("rank"), ["query_id"], "weighted", "id", config.top_k + GRAPH_HITS)
    score = F.when(F.col("source") == "graph", F.lit(None)).otherwise(display_score(F.col("vector_score")))
    return best.select("id", "rank", "source", score.cast("double").alias("score"), "rrf_score", "weighted", "keyword_hits", "content")


def context_line(kind: Column, title: Column, content: Column, score: Column) -> Column:
    """A hit as a paragraph of the prompt's context; code is kept longer than prose."""
    code = F.substring(content, 1, 200).rlike(r"```|def |class |import |function |SELECT ")
    return (
        F.when(kind == "graph", F.concat(F.lit("[graph] "), title, F.lit(": "), F.substring(content, 1, 800)))
        .when(code, F.concat(F.lit("[code] "), title, F.lit("\n"), F.substring(content, 1, 1500)))
        .otherwise(F.concat(F.lit("[document] "), title, F.lit(" ("), F.format_number(score, 2), F.lit(")\n"), F.substring(content, 1, 1000)))
    )


def citations(hits: DataFrame, n: int = 3) -> DataFrame:
    """The first n hits as citations of 300 characters."""
    return hits.filter(F.col("rank") <= n).select("rank", "doc_id", F.coalesce("title", F.lit("untitled")).alias("title"), F.substring("content", 1, 300).alias("snippet"), "score")
