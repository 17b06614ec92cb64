"""Scalar text functions and intents over the driver's texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import intent as I
from loreweave.functions import text as T
from loreweave.operators.answers import NOT_FOUND, faq_override, final_answer, outcome
from loreweave.operators.lifecycle import add_absent
from loreweave.sources.tables import documents, messages, table

from .registry import query

_SPACE = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _halves(*marks: Column) -> Column:
    """The whole text cut in two, with marks before, between and behind."""
    middle = F.floor(F.length("content") / 2).cast("int")
    return F.concat(marks[0], F.substr("content", F.lit(1), middle), marks[1], F.substr("content", middle + 1), *marks[2:])


_CUT = "(SELECT doc_id, lang, source, text, substr(text, 1, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b FROM documents)"


@query(r"SELECT doc_id, regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS text FROM documents")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.normalise(F.col("content")).alias("text"))


@query(f"SELECT doc_id, {_SPACE.format('b')} AS text FROM {_CUT}")
def strip_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _halves(F.lit("<think>"), F.lit("</think> "))
    return documents(spark, sf_dir).select("doc_id", T.strip_think(said).alias("text"))


@query(f"SELECT doc_id, '①' || a || CASE WHEN n > 1 THEN '②' ELSE '' END || b || CASE WHEN n > 2 THEN '③' ELSE '' END AS text FROM (SELECT *, doc_id % 3 + 1 AS n FROM {_CUT})")
def align_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _halves(F.lit("⑤"), F.lit("②"))
    return documents(spark, sf_dir).select("doc_id", T.align_citations(said, (F.col("doc_id") % 3 + 1).cast("int")).alias("text"))


@query("SELECT event_id, '10.' || user_id % 200 || '.7.0' AS ip FROM events")
def anonymize_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.concat(F.lit("10."), (F.col("user_id") % 200).cast("string"), F.lit(".7."), (F.col("event_id") % 250).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.anonymous_ip(ip).alias("ip"))


@query("SELECT doc_id, md5(lang || '::' || trim(text) || '::k=' || doc_id || '|source=' || source) AS key FROM documents")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", T.cache_key(F.col("kb_id"), F.col("content"), {"source": F.col("category"), "k": F.col("doc_id")}).alias("key"))


#: What is planted in the middle of each text, in turn.
PLACED = ("[object Object]", "<undefined>", "<null>", "<empty>", "{{a.b-c}}", "${x}", "undefined", "null", "NaN", "nullable")


@query(f"SELECT doc_id, CASE WHEN {_SPACE.format('a || b')} = '' AND k < 9 THEN '{T.USELESS}' ELSE a || ' ' || CASE WHEN k < 9 THEN '{T.ODD}' ELSE 'nullable' END || ' ' || b END AS text FROM (SELECT *, doc_id % 10 AS k FROM {_CUT})")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each placeholder, and a word that only looks like one."""
    mark = F.get(F.array(*map(F.lit, PLACED)), (F.col("doc_id") % len(PLACED)).cast("int"))
    return documents(spark, sf_dir).select("doc_id", T.sanitise(_halves(F.lit(""), F.concat(F.lit(" "), mark, F.lit(" ")))).alias("text"))


def _score(rule: I.Rule) -> str:
    keys = " + ".join(f"CAST(contains(t, '{k.lower()}') AS INTEGER)" for k in rule.keywords)
    patterns = " + ".join(f"CAST(regexp_matches(t, '{p}') AS INTEGER)" for p in rule.patterns)
    return f"round(({keys} + {patterns}) * {rule.weight}, 6)"


def _any(patterns: tuple[str, ...]) -> str:
    return "regexp_matches(t, '" + "|".join(f"(?:{p})" for p in patterns if "(?!" not in p) + "')"


@query(rf"""
WITH q AS (SELECT conv_id, turn, text, regexp_replace(lower(regexp_replace(substr(text, 1, 2000), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS t FROM conversations WHERE role = 'user'),
s AS (SELECT *, {_score(I.NEGATION)} AS n, {_score(I.GREETING)} AS g, {_score(I.CHITCHAT)} AS c, {_score(I.META)} AS m, {_score(I.FAQ)} AS f, {_score(I.OUT_OF_SCOPE)} AS o FROM q)
SELECT conv_id, turn,
    CASE WHEN t = '' OR NOT regexp_matches(t, '[\p{{L}}\p{{N}}]') THEN 'chitchat' WHEN n > 0 THEN 'negation' WHEN g > 0 AND g >= c THEN 'greeting' WHEN c > 0 THEN 'chitchat' WHEN {_any(I.META_FIRST)} THEN 'meta_query'
        WHEN f > 0 AND {_any(I.CONTENT_FIRST)} THEN 'kb_content' WHEN f > 0 THEN 'system_faq' WHEN m > 0 THEN 'meta_query' WHEN o > 0 THEN 'out_of_scope' ELSE 'kb_content' END AS intent,
    CAST(round(CASE WHEN t = '' THEN 0.99 WHEN NOT regexp_matches(t, '[\p{{L}}\p{{N}}]') THEN 0.95 WHEN n > 0 THEN least(0.95, 0.6 + n * 0.1) WHEN g > 0 AND g >= c THEN least(0.95, 0.5 + g * 0.15) WHEN c > 0 THEN least(0.9, 0.4 + c * 0.15)
        WHEN {_any(I.META_FIRST)} THEN 0.92 WHEN f > 0 AND {_any(I.CONTENT_FIRST)} THEN 0.65 WHEN f > 0 THEN least(0.95, 0.5 + f * 0.1) WHEN m > 0 THEN least(0.95, 0.5 + m * 0.1) WHEN o > 0 THEN least(0.85, 0.4 + o * 0.15) ELSE 0.5 END, 4) AS DOUBLE) AS confidence
FROM s""")
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = messages(spark, sf_dir).filter("role = 'user'")
    return asked.select("conv_id", "turn", I.intent(F.col("text")).alias("i")).select("conv_id", "turn", "i.intent", "i.confidence")


#: Questions, and whether each is a follow-up of earlier turns: by the short rule, and by the rule that looks at its subject.
ASKED = (
    ("什么是检索增强", True, False), ("hi there", True, False), ("它是怎么工作的，请讲给我听一听吧", True, True), ("please explain the whole retrieval pipeline", False, False),
    ("这个系统的详细步骤是什么，请列出来", True, True), ("介绍一下你的系统还有上面的全部内容", True, False), ("具体的操作流程应当如何理解才对呢", True, True),
)
_ASKED = ", ".join(f"({k}, {short}, {subject})" for k, (_, short, subject) in enumerate(ASKED))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that ask the planted questions in turn, and whether something was said before."""
    m = messages(spark, sf_dir)
    first = m.groupBy("conv_id").agg(F.min("turn").alias("_m"))
    text = F.get(F.array(*(F.lit(q) for q, _, _ in ASKED)), ((F.col("conv_id") + F.col("turn")) % len(ASKED)).cast("int"))
    return m.join(first, "conv_id").filter("role = 'user'").select("conv_id", "turn", text.alias("text"), (F.col("turn") > F.col("_m")).alias("later"))


def _asked_sql(which: str) -> str:
    return f"WITH a(k, short, subject) AS (VALUES {_ASKED}) SELECT conv_id, turn, turn > m AND {which} AS is_follow_up FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) JOIN a ON (conv_id + turn) % {len(ASKED)} = k WHERE role = 'user'"


@query(_asked_sql("short"))
def followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", I.follow_up_legacy(F.col("text"), F.col("later")).alias("is_follow_up"))


@query(_asked_sql("subject"))
def followup_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", I.follow_up(F.col("text"), F.col("later")).alias("is_follow_up"))


@query("SELECT doc_id, CAST(len(string_split(lower(text), 'tion')) - 1 AS INTEGER) AS n FROM documents")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.occurrences(F.lower("content"), F.lit("tion")).alias("n"))


@query("SELECT doc_id, 'Title: doc_' || doc_id || ', language: ' || lang || ', {unknown}' AS text FROM documents")
def fill_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", T.fill_template(F.lit("Title: {title}, language: {kb}, {unknown}"), {"title": F.col("title"), "kb": F.col("kb_id")}).alias("text"))


@query(f"SELECT doc_id, {_SPACE.format('a')} AS thought, {_SPACE.format('b')} AS answer FROM {_CUT}")
def split_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    thought, answer = T.split_think(_halves(F.lit("<think>"), F.lit("</think> ")))
    return documents(spark, sf_dir).select("doc_id", thought.alias("thought"), answer.alias("answer"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '\n-+\s*$', ''), '\s+$', '') AS text FROM documents")
def strip_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each heading in turn, plain, bold or as a heading, behind the whole text."""
    head = F.get(F.array(*map(F.lit, T.TAILS)), (F.col("doc_id") % len(T.TAILS)).cast("int"))
    lead = F.get(F.array(F.lit(""), F.lit("**"), F.lit("## ")), (F.col("doc_id") % 3).cast("int"))
    said = F.concat(F.col("content"), F.lit("\n"), lead, head, F.lit("：\n1. "), F.col("title"))
    return documents(spark, sf_dir).select("doc_id", T.strip_tails(said).alias("text"))


@query("SELECT event_id, ts AS at FROM events")
def parse_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with and without fractions, written as text and read back."""
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.date_trunc("second", ts) == ts, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return table(spark, sf_dir, "events").select("event_id", T.parse_iso(text).cast("timestamp_ntz").alias("at"))


@query(r"SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN true WHEN doc_id % 4 = 2 THEN false ELSE NOT regexp_matches(text, '[a-zA-Z0-9]') END AS odd, CAST(doc_id % 3 AS INTEGER) AS emoji FROM documents")
def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, marks alone and marks with one character; and runs of emoji behind a text."""
    text = F.when(F.col("doc_id") % 4 == 1, "😀 !!! …").when(F.col("doc_id") % 4 == 2, "!! 好 !!").otherwise(F.col("content"))
    runs = F.concat(F.col("content"), F.lit(" "), F.expr("repeat('😀😀 ', CAST(doc_id % 3 AS INT))"))
    return documents(spark, sf_dir).select("doc_id", T.no_letters_or_digits(text).alias("odd"), T.emoji_runs(runs).alias("emoji"))


@query("SELECT event_id, props AS found FROM events")
def json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" as asked."))
    return table(spark, sf_dir, "events").select("event_id", T.json_object(said).alias("found"))


@query(r"SELECT doc_id, CASE WHEN k = 0 THEN text ELSE regexp_replace(regexp_extract(substr(text, 1, k - 1), '(?s)^(.*[。！？.!?])', 1), '^\s+|\s+$', '', 'g') END AS text FROM (SELECT *, instr(text, ' is ') AS k FROM documents)")
def cut_at_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.cut_at_first(F.col("content"), [" is "]).alias("text"))


@query("SELECT p_partkey, lower(trim(p_brand)) AS tag FROM part")
def tag_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.tag_name(F.concat(F.lit("  "), F.col("p_brand"), F.lit(" \t"))).alias("tag"))


@query("SELECT vec_id, 'chunks_d' || len(embedding) AS collection FROM embeddings")
def collection_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", T.collection_name(F.size("embedding")).alias("collection"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND turn % 2 = 0 THEN '知识库中{0}相关内容' WHEN turn % 3 = 0 THEN '{0}。' ELSE text END AS answer FROM conversations WHERE text <> ''".format(NOT_FOUND[0]))
def final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third answer found nothing; of those, even turns have no citation."""
    said = F.when(F.col("turn") % 3 == 0, NOT_FOUND[0] + "。").otherwise(F.col("text"))
    return messages(spark, sf_dir).filter("text <> ''").select("conv_id", "turn", final_answer(said, (F.col("turn") % 2).cast("int"), F.lit(False)).alias("answer"))


#: Parts of an answer that say that nothing was found, ask again and cite.
_SAID = ("知识库中未找到相关内容。", "建议换个问法。", "见①。")
#: What becomes of the eight answers of these parts, without and with a hit that was worth reading.
_BECOMES = ("kept", "no_match", "no_match", "no_match", "kept", "no_match", "kept", "no_match"), ("kept", "no_definition", "no_definition", "no_definition", "kept", "no_match", "kept", "no_match")
_OUTCOMES = ", ".join(f"({k}, {n}, '{o}')" for n, side in enumerate(_BECOMES) for k, o in enumerate(side))


@query(f"WITH v(k, n, o) AS (VALUES {_OUTCOMES}) SELECT doc_id, o AS outcome FROM documents JOIN v ON doc_id % 8 = k AND (doc_id // 8) % 2 = n")
def answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as answers, with each set of the parts behind them."""
    part = lambda k: F.when(F.floor(F.col("doc_id") / (1 << k)) % 2 == 1, _SAID[k]).otherwise("")
    said = F.concat("content", part(0), part(1), part(2))
    return documents(spark, sf_dir).select("doc_id", outcome(said, F.floor(F.col("doc_id") / 8) % 2).alias("outcome"))


#: Questions on the system, and whether the faqs answer them where search found something.
FAQ_ASKED = (("本系统 功能", True), ("LangChain 原理", False), ("知识库 介绍", True), ("如何 怎么", True), ("平台 zzz", True), ("工具 yyy", False))
_FAQ = "VALUES ('faq_0', '知识库介绍', '本系统 提供检索 功能。平台说明。'), ('faq_1', '使用方式', '知识库 上传与提问。')"


@query("WITH f(id, title, content) AS (" + _FAQ + "), q(k, faq) AS (VALUES " + ", ".join(f"({k}, {faq})" for k, (_, faq) in enumerate(FAQ_ASKED)) + ") SELECT k, id, 'faq' AS source FROM q, f WHERE faq UNION ALL SELECT k, 'doc_' || doc_id, 'search' FROM q, documents WHERE NOT faq AND lang = 'fr'")
def faq_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with the French documents as what search found."""
    faqs = spark.createDataFrame([("faq_0", "知识库介绍", "本系统 提供检索 功能。平台说明。"), ("faq_1", "使用方式", "知识库 上传与提问。")], "id string, title string, content string")
    hits = documents(spark, sf_dir).filter("kb_id = 'fr'").select(F.col("title").alias("id"), "title", "content")
    return reduce(DataFrame.unionByName, (faq_override(q, hits, faqs).select(F.lit(k).alias("k"), "id", "source") for k, (q, _) in enumerate(FAQ_ASKED)))


@query("WITH f(id, title, content) AS (" + _FAQ + ") SELECT id, title FROM f UNION ALL SELECT 'doc_' || doc_id, 'doc_' || doc_id FROM documents")
def faq_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds are added where they are absent; the second time none is."""
    seeds = spark.createDataFrame([("faq_0", "知识库介绍"), ("faq_1", "使用方式")], "id string, title string")
    held = documents(spark, sf_dir).select(F.col("title").alias("id"), "title")
    return add_absent(add_absent(held, seeds, ["id"]), seeds, ["id"])
