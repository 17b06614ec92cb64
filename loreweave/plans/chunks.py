"""Chunking queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.text import strip, token_estimate
from loreweave.operators import chunking as C
from loreweave.sources import files
from loreweave.sources.tables import documents

from .registry import query

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
FIXED_SQL = rf"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, c AS text FROM (
    SELECT doc_id, i, {_STRIP.format('substr(text, i * 400 + 1, 500)')} AS c FROM (
        SELECT doc_id, text, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 500 THEN 1 ELSE CAST(1 + ceil((length(text) - 500) / 400.0) AS BIGINT) END)) AS i FROM documents)
) WHERE c <> ''"""
_SLIDING = "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(text, i * {1} + 1, {0}) AS text FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / {1}.0) AS BIGINT))) AS i FROM documents)"


_NO_TEXTS = "CAST([] AS VARCHAR[])"


def _fold_sql(units: str, fits: str, longer: str, fresh: str, docs: str = "documents", more: str = "") -> str:
    """Chunks of a fold over units, a list of structs (u, and further fields) of a text t; in the conditions s is the state and x the unit.

    Lists are folded from their first element, so the state has the units' shape.
    """
    flushed = f"CASE WHEN {_STRIP.format('{0}.open')} <> '' THEN list_append({{0}}.done, {_STRIP.format('{0}.open')}) ELSE {{0}}.done END"
    return f"""
WITH d AS (SELECT doc_id, {units} AS units FROM (SELECT doc_id, text AS t FROM {docs})),
f AS (
    SELECT doc_id, list_reduce([{{'open': '', 'done': {_NO_TEXTS}, 'x': CAST(NULL AS STRUCT(u VARCHAR, n BIGINT, flag BOOLEAN))}}] || list_transform(units, lambda v: {{'open': '', 'done': {_NO_TEXTS}, 'x': v}}),
        lambda s, v: CASE WHEN {fits} THEN {{'open': {longer}, 'done': s.done, 'x': {more or 's.x'}}} ELSE {{'open': {fresh}, 'done': {flushed.format('s')}, 'x': {more or 's.x'}}} END) AS e
    FROM d
)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, c AS text FROM (SELECT doc_id, unnest(range(len(cs))) AS i, unnest(cs) AS c FROM (SELECT doc_id, {flushed.format('e')} AS cs FROM f))"""


def _units(found: str, flag: str = "false", n: str = "length(x)") -> str:
    """Units of a list of texts x."""
    return f"list_transform({found}, lambda x: CAST({{'u': x, 'n': {n}, 'flag': {flag}}} AS STRUCT(u VARCHAR, n BIGINT, flag BOOLEAN)))"


_ENDED = f"regexp_extract_all({{0}}, '[^{C.END[1:-1]}]*{C.END}')"
_TRIMMED = f"list_filter(list_transform({{0}}, lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_PARAGRAPHS = _TRIMMED.format("string_split(t, chr(10) || chr(10))")
#: Texts with headings, blank lines, Chinese full stops and words that turn to something else.
_PLANTED_SQL = "(SELECT doc_id, '# 第一章' || chr(10) || replace(replace(replace(text, '. T', '. 但是T'), '. ', '。 '), chr(10), chr(10) || ' ' || chr(10) || chr(10) || '## part' || chr(10)) AS text FROM documents)"
RECURSIVE_SQL = _fold_sql(
    f"""flatten(list_transform({_PARAGRAPHS}, lambda p: CASE WHEN length(p) > 500
        THEN [CAST({{'u': '', 'n': 0, 'flag': true}} AS STRUCT(u VARCHAR, n BIGINT, flag BOOLEAN))] || {_units(_ENDED.format('p'))}
        ELSE [CAST({{'u': p || chr(10) || chr(10), 'n': length(p), 'flag': false}} AS STRUCT(u VARCHAR, n BIGINT, flag BOOLEAN))] END))""",
    "NOT v.x.flag AND length(s.open) + v.x.n < 500", "s.open || v.x.u", "v.x.u",
)
SEMANTIC_SQL = _fold_sql(
    _units(_TRIMMED.format(_ENDED.format("t"))),
    f"NOT (length(s.open) > 250 AND regexp_matches(substr(v.x.u, 1, 10), '{'|'.join(C.TRANSITIONS)}')) AND length(s.open) + v.x.n < 500", "s.open || v.x.u", "v.x.u",
)
_WITH_REST = rf"list_transform(regexp_extract_all(t, '[^{C.END[1:-1]}]*{C.END}\s*|[^{C.END[1:-1]}]+$'), lambda x: regexp_replace(x, '({C.END})\s*$', '\1'))"
SENTENCES_SQL = _fold_sql(_units(f"list_filter({_WITH_REST}, lambda x: {_STRIP.format('x')} <> '')"), "length(s.open) + v.x.n <= 500", "s.open || v.x.u", "v.x.u")
# The state keeps the last heading as its unit; its flag says that there is one.
STRUCTURE_SQL = _fold_sql(
    _units(_TRIMMED.format("string_split(t, chr(10))"), flag=f"regexp_matches(x, '{C.HEADING}')"),
    "NOT v.x.flag AND length(s.open) + v.x.n < 500", "s.open || v.x.u || chr(10)", "CASE WHEN NOT v.x.flag AND coalesce(s.x.flag, false) THEN s.x.u || chr(10) ELSE '' END || v.x.u || chr(10)",
    more="CASE WHEN v.x.flag THEN v.x ELSE s.x END",
)
_BLOCKS = _TRIMMED.format(r"string_split_regex(t, '\n[ \t]*\n')")
# A page is flushed when it is full, so the state keeps how many characters its blocks have.
TEXT_PAGES_SQL = f"""
WITH d AS (SELECT doc_id, {_BLOCKS} AS bs FROM (SELECT doc_id, text AS t FROM documents)),
f AS (
    SELECT doc_id, list_reduce([{{'open': '', 'n': CAST(0 AS BIGINT), 'done': {_NO_TEXTS}}}] || list_transform(bs, lambda b: {{'open': b, 'n': length(b), 'done': {_NO_TEXTS}}}),
        lambda s, v: CASE WHEN s.n + v.n >= 2000 THEN {{'open': '', 'n': 0, 'done': list_append(s.done, CASE WHEN s.open = '' THEN v.open ELSE s.open || chr(10) || chr(10) || v.open END)}}
            ELSE {{'open': CASE WHEN s.open = '' THEN v.open ELSE s.open || chr(10) || chr(10) || v.open END, 'n': s.n + v.n, 'done': s.done}} END) AS e
    FROM d
)
SELECT 'doc_' || doc_id AS path, CAST(k AS INTEGER) AS page_number, CAST(NULL AS VARCHAR) AS section_title, page AS text FROM (
    SELECT doc_id, unnest(range(1, len(ps) + 1)) AS k, unnest(ps) AS page FROM (SELECT doc_id, CASE WHEN e.open <> '' THEN list_append(e.done, e.open) ELSE e.done END AS ps FROM f))"""
_HEADED_TEXT = "'# One' || chr(10) || substr(text, 1, 40) || chr(10) || '## Two ' || chr(10) || text || chr(10) || '### no' || chr(10) || '## ' || chr(10) || '  '"


def CELLS_SQL(keys: str, source: str) -> str:
    """Cells of the texts of source (keys, text)."""
    return f"""
    SELECT {keys}, idx, w / (sqrt(sum(w * w) OVER (PARTITION BY {keys})) + 1e-8) AS weight FROM (
    SELECT {keys}, CAST(h % 512 AS INTEGER) AS idx, sum(CASE WHEN h >= 2147483648 THEN -1.0 ELSE 1.0 END) AS w FROM (
        SELECT {keys}, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT {keys}, unnest(list_concat(list_concat(
            list_transform(list_filter(list_transform(range(length(s)), lambda i: substr(s, i + 1, 1)), lambda x: regexp_matches(x, '\\S')), lambda x: 'c:' || x),
            list_transform(list_filter(list_transform(range(length(s) - 1), lambda i: substr(s, i + 1, 2)), lambda x: regexp_matches(x, '\\S')), lambda x: 'b:' || x)),
            list_transform(regexp_extract_all(s, '[A-Za-z0-9]+|[一-鿿]+'), lambda x: 'w:' || lower(x)))) AS tok
        FROM (SELECT {keys}, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM {source}))) GROUP BY ALL HAVING sum(CASE WHEN h >= 2147483648 THEN -1.0 ELSE 1.0 END) <> 0)"""


def base_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed windows, with their document's category."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", "category", "kb_id", F.posexplode(C.fixed(F.col("content"))).alias("chunk_index", "text"))


@query(FIXED_SQL)
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(documents(spark, sf_dir), "doc_id", C.fixed(F.col("content")))


@query(_SLIDING.format(500, 450))
def chunk_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(documents(spark, sf_dir), "doc_id", C.naive(F.col("content")))


@query(_SLIDING.format(1500, 1350))
def chunk_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(documents(spark, sf_dir), "doc_id", C.general(F.col("content")))


@query(f"WITH c AS ({FIXED_SQL}) SELECT doc_id, chunk_index, coalesce(right(lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index), 50), '') || text AS text FROM c")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_overlap(chunk_fixed(spark, sf_dir), "doc_id", 50)


@query(f"WITH c AS ({FIXED_SQL}) SELECT doc_id, chunk_index, coalesce(right(lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index), 192) || ' ', '') || text AS text FROM c")
def chunk_overlap_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_overlap(chunk_fixed(spark, sf_dir), "doc_id", 192, " ")


@query("SELECT doc_id, CAST(floor(zh / 1.5 + (length(text) - zh) / 4) AS INTEGER) AS token_count FROM (SELECT doc_id, text, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS zh FROM documents)")
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", token_estimate(F.col("content")).alias("token_count"))


_TITLE = r"""regexp_matches({0}, '^(?:第[一二三四五六七八九十百\d]+[章节回]|Chapter\s+\d+|#{{1,6}}\s)') OR (length({0}) < 50 AND NOT regexp_matches({0}, '[。！？.!?,，;；:：]$'))"""
_LINES = rf"SELECT doc_id, i, {_STRIP.format('x')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"


@query(f"SELECT doc_id, count(*) AS n_titles FROM ({_LINES}) WHERE line <> '' AND ({_TITLE.format('line')}) GROUP BY doc_id")
def chunk_book_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split("content", "\n")).alias("line")).select("doc_id", strip(F.col("line")).alias("line"))
    return lines.filter("line <> ''").filter(C.is_title(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_titles"))


def _sections_sql(test: str, least: int) -> str:
    return f"""
WITH l AS (SELECT * FROM ({_LINES}) WHERE line <> ''),
f AS (SELECT *, CASE WHEN {test} THEN 1 ELSE 0 END AS start, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l),
s AS (SELECT *, CAST(sum(CASE WHEN r = 1 THEN 0 ELSE start END) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS section FROM f)
SELECT doc_id, section, string_agg(line, chr(10) ORDER BY i) AS text FROM s GROUP BY doc_id, section HAVING length(string_agg(line, chr(10) ORDER BY i)) > {least}"""


def _keyword_sql(words: tuple[str, ...], below: int) -> str:
    return f"length(line) < {below} AND regexp_matches(lower(line), '" + "|".join(words) + "')"


@query(_sections_sql(_keyword_sql(C.PAPER_SECTIONS, 100), 50))
def chunk_paper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sections(documents(spark, sf_dir), "doc_id", "content", lambda x: C.has_keyword(x, C.PAPER_SECTIONS, 100), 50)


#: A heading behind every third line, so that texts have sections.
HEADINGS = ("Abstract", "2 相关工作 (Related Work)", "Work Experience", "专业技能", "Conclusion")


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one of the headings between all lines."""
    docs = documents(spark, sf_dir)
    head = F.get(F.array(*map(F.lit, HEADINGS)), (F.col("doc_id") % len(HEADINGS)).cast("int"))
    return docs.withColumn("content", F.replace("content", F.lit("\n"), F.concat(F.lit("\n"), head, F.lit("\n"))))


_HEADED_DOCS = "headed AS (SELECT doc_id, replace(text, chr(10), chr(10) || h || chr(10)) AS text FROM documents JOIN (VALUES " + ", ".join(f"({k}, '{h}')" for k, h in enumerate(HEADINGS)) + f") v(k, h) ON doc_id % {len(HEADINGS)} = k)"


def _titled_sql(test: str, least: int, most: int) -> str:
    """Line by line: where a section starts, how full it is, and whether it is cut behind the line."""
    start, size = f"({test})", "CASE WHEN f.cut THEN 0 ELSE f.size END + length(l.line)"
    return f"""
WITH RECURSIVE {_HEADED_DOCS},
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, line FROM ({_LINES.replace('FROM documents', 'FROM headed')}) WHERE line <> ''),
f AS (
    SELECT doc_id, r, line, CAST(0 AS BIGINT) AS id, CASE WHEN {start} THEN line END AS title, CAST(length(line) AS BIGINT) AS size, NOT {start} AND length(line) > {most} AS cut FROM l WHERE r = 1
    UNION ALL
    SELECT l.doc_id, l.r, l.line, f.id + CASE WHEN {start.replace('line', 'l.line')} OR f.cut THEN 1 ELSE 0 END, CASE WHEN {start.replace('line', 'l.line')} THEN l.line ELSE f.title END,
        CASE WHEN {start.replace('line', 'l.line')} THEN length(l.line) ELSE {size} END, NOT {start.replace('line', 'l.line')} AND {size} > {most}
    FROM f JOIN l ON l.doc_id = f.doc_id AND l.r = f.r + 1
),
c AS (SELECT doc_id, id, title, string_agg(line, chr(10) ORDER BY r) AS text, bool_or(cut) AS cut FROM f GROUP BY doc_id, id, title)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1 AS INTEGER) AS chunk_index, title AS section_title, text FROM c WHERE cut OR length(text) > {least}"""


def _titled(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    return C.chunk_texts(_headed(spark, sf_dir), "doc_id", "content", strategy).select("doc_id", "chunk_index", "section_title", "text")


@query(_titled_sql(_keyword_sql(C.PAPER_SECTIONS, 100), 50, 2_000_000_000))
def chunk_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled(spark, sf_dir, "paper")


@query(_titled_sql(_keyword_sql(C.RESUME_SECTIONS, 50), 20, 2_000_000_000))
def chunk_resume_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled(spark, sf_dir, "resume")


@query(_titled_sql(_TITLE.format("line"), 100, 1536))
def chunk_book_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that are cut when they grow too long."""
    return _titled(spark, sf_dir, "book")


@query(_sections_sql(_TITLE.format("line"), 100))
def chunk_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sections(documents(spark, sf_dir), "doc_id", "content", C.is_title, 100)


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, '表格数据（列：a, b）' || chr(10) || line AS text FROM l WHERE regexp_matches(line, '\\S')""")
def chunk_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(documents(spark, sf_dir), "doc_id", C.rows_of_table(F.col("content"), ["a", "b"]))


@query("SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CASE WHEN doc_id % 2 = 1 THEN text ELSE '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || doc_id || ' | ' || k || ' |' END AS text FROM documents, (VALUES (0), (1)) t(k) WHERE doc_id % 2 = 0 OR k = 0")
def chunk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Markdown tables in every other text; the others stay whole."""
    made = lambda k: F.concat(F.lit("\n| a | b |\n|---|:-:|\n| "), F.col("doc_id").cast("string"), F.lit(f" | {k} |\n"))
    docs = documents(spark, sf_dir)
    docs = docs.withColumn("content", F.when(F.col("doc_id") % 2 == 0, F.concat(made(0), F.replace("content", F.lit("|"), F.lit("/")), made(1))).otherwise(F.col("content")))
    return C.exploded(docs, "doc_id", C.table(F.col("content")))


@query("""
WITH p AS (
    SELECT doc_id, 1 AS n, true AS sheet, text AS t FROM documents
    UNION ALL SELECT doc_id, 2, false, 'see | a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || doc_id || ' | 1 |' || chr(10) || chr(10) || '| 2 | 3 |' || chr(10) || replace(text, '|', '/') FROM documents
    UNION ALL SELECT doc_id, 3, false, replace(text, '|', '/') FROM documents
), l AS (
    SELECT doc_id, n, 'table_row' AS kind, '表格数据（列：a, b）' || chr(10) || line AS text, i FROM (
        SELECT doc_id, n, unnest(string_split(s, chr(10))) AS line, unnest(range(len(string_split(s, chr(10))))) AS i FROM (SELECT doc_id, n, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS s FROM p WHERE sheet)
    ) WHERE regexp_matches(line, '\\S')
    UNION ALL SELECT doc_id, n, 'table', regexp_extract(t, '^see ((?:\\|[^\\n]*\\n+)+)', 1), 0 FROM p WHERE n = 2
    UNION ALL SELECT doc_id, n, 'page', t, 0 FROM p WHERE n = 3
), placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, i) - 1 AS k FROM l)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS page_number, kind, CASE kind WHEN 'table_row' THEN '数据行 ' || (k + 1) WHEN 'table' THEN 'Table 1' ELSE 'part ' || n END AS section_title,
    CASE WHEN kind = 'table' THEN regexp_replace(text, '\\n+$', '') ELSE text END AS text FROM placed""")
def chunk_table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a sheet of two columns, behind a Markdown table, and as a plain page."""
    docs = documents(spark, sf_dir)
    plain = F.replace("content", F.lit("|"), F.lit("/"))
    tabled = F.concat(F.lit("see | a | b |\n|---|:-:|\n| "), F.col("doc_id").cast("string"), F.lit(" | 1 |\n\n| 2 | 3 |\n"), plain)
    page = lambda n, text, names: F.struct(F.lit(n).alias("page_number"), F.lit(f"part {n}").alias("section_title"), text.alias("text"), names.cast("array<string>").alias("headers"))
    pages = docs.select("doc_id", F.inline(F.array(page(1, F.col("content"), F.array(F.lit("a"), F.lit("b"))), page(2, tabled, F.array()), page(3, plain, F.lit(None)))))
    return C.chunk_table_pages(pages, "doc_id").select("doc_id", "chunk_index", "page_number", "kind", "section_title", "text")


_NAMES = ("fixed", "recursive", "structure", "semantic", "naive", "general", "intelligent", "parent_child", "book", "paper", "resume", "qa", "table", "auto", "unknown")


@query(f"SELECT n AS name, count(doc_id) AS n_docs FROM (VALUES {', '.join(f"({k}, '{n}')" for k, n in enumerate(_NAMES[:13]))}) t(k, n) LEFT JOIN documents ON doc_id % 13 = k GROUP BY n")
def chunk_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of strategies, with the documents that each is given in turn."""
    names = spark.createDataFrame([(k, n) for k, n in enumerate(C.strategies())], "k long, name string")
    used = documents(spark, sf_dir).groupBy((F.col("doc_id") % 13).alias("k")).agg(F.count(F.lit(1)).alias("_n"))
    return names.join(used, "k", "left").select("name", F.coalesce("_n", F.lit(0)).alias("n_docs"))


@query("""
WITH p AS (SELECT doc_id, 1 AS n, substr(text, 1, length(text) // 2) AS t FROM documents UNION ALL SELECT doc_id, 2, substr(text, length(text) // 2 + 1) FROM documents),
c AS (SELECT doc_id, n, i, substr(t, i * 448 + 1, 512) AS text FROM (SELECT doc_id, n, t, unnest(range(CAST(ceil(length(t) / 448.0) AS BIGINT))) AS i FROM p))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, i) - 1 AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS page_number, 'part ' || n AS section_title, text, CAST(floor(length(text) / 4) AS INTEGER) AS token_count FROM c""")
def chunk_over_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text in two pages; chunks are numbered over both."""
    docs = documents(spark, sf_dir)
    half = F.floor(F.length("content") / 2).cast("int")
    two = F.array(F.struct(F.lit(1).alias("page_number"), F.substr("content", F.lit(1), half).alias("text")), F.struct(F.lit(2).alias("page_number"), F.substr("content", half + 1).alias("text")))
    pages = docs.select("doc_id", F.inline(two)).withColumn("section_title", F.concat(F.lit("part "), F.col("page_number").cast("string")))
    return C.chunk_pages(pages, "doc_id", "naive")


@query(f"""
SELECT doc_id, n AS name, CASE WHEN n IN ('naive', 'table', 'fixed') THEN 'fixed' WHEN n IN ('intelligent', 'book', 'paper', 'resume', 'structure') THEN 'structure' WHEN n = 'semantic' THEN 'semantic' ELSE 'recursive' END AS strategy
FROM documents JOIN (VALUES {', '.join(f"({k}, '{n}')" for k, n in enumerate(_NAMES))}) t(k, n) ON doc_id % {len(_NAMES)} = k""")
def chunk_strategy_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The algorithm behind the name that each document asks for."""
    asked = F.get(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES)).cast("int"))
    return documents(spark, sf_dir).select("doc_id", asked.alias("name")).withColumn("strategy", C.strategy_of(F.col("name")))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.replace(F.replace("content", F.lit(". T"), F.lit(". 但是T")), F.lit(". "), F.lit("。 ")), F.lit("\n"), F.lit("\n \n\n## part\n"))
    return documents(spark, sf_dir).withColumn("content", F.concat(F.lit("# 第一章\n"), text))


@query(RECURSIVE_SQL.replace("FROM documents)", f"FROM {_PLANTED_SQL})"))
def chunk_recursive_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(_planted(spark, sf_dir), "doc_id", C.recursive(F.col("content")))


@query(STRUCTURE_SQL.replace("FROM documents)", f"FROM {_PLANTED_SQL})"))
def chunk_structure_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(_planted(spark, sf_dir), "doc_id", C.structure(F.col("content")))


@query(SEMANTIC_SQL.replace("FROM documents)", f"FROM {_PLANTED_SQL})"))
def chunk_semantic_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(_planted(spark, sf_dir), "doc_id", C.semantic(F.col("content")))


@query(SENTENCES_SQL.replace("FROM documents)", f"FROM {_PLANTED_SQL})"))
def chunk_sentences_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(_planted(spark, sf_dir), "doc_id", C.sentences(F.col("content")))


@query(TEXT_PAGES_SQL.replace("FROM documents)", f"FROM {_PLANTED_SQL})"))
def text_pages_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.text_pages(_planted(spark, sf_dir).select(F.col("title").alias("path"), F.col("content").alias("text")))


@query(RECURSIVE_SQL)
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(documents(spark, sf_dir), "doc_id", C.recursive(F.col("content")))


@query(STRUCTURE_SQL)
def chunk_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(documents(spark, sf_dir), "doc_id", C.structure(F.col("content")))


@query(SEMANTIC_SQL)
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(documents(spark, sf_dir), "doc_id", C.semantic(F.col("content")))


@query(SENTENCES_SQL)
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(documents(spark, sf_dir), "doc_id", C.sentences(F.col("content")))


@query()
def chunk_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(documents(spark, sf_dir), "doc_id", C.questions(F.col("content")))


@query()
def chunk_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.parent_child(documents(spark, sf_dir), "doc_id", "content")


@query()
def chunk_punctuated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(documents(spark, sf_dir), "doc_id", C.punctuated(F.col("content")))


@query()
def chunk_by_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(documents(spark, sf_dir), "doc_id", C.by_separators(F.col("content")))


@query()
def chunk_token_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(documents(spark, sf_dir), "doc_id", C.token_bounded(F.col("content")))


@query()
def chunk_intelligent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.intelligent(documents(spark, sf_dir), "doc_id", "content")


@query()
def chunk_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_category(documents(spark, sf_dir), "doc_id", "content", {"src0": ("fixed", 400, 80), "src1": ("semantic", 500, 0), "src2": ("book", 800, 0)})


@query(TEXT_PAGES_SQL)
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.text_pages(documents(spark, sf_dir).select(F.col("title").alias("path"), F.col("content").alias("text")))


@query(f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split({_HEADED_TEXT}, chr(10)) AS ls FROM documents)),
m AS (SELECT *, sum(CASE WHEN i = 0 OR regexp_matches(line, '^##? ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l),
p AS (SELECT doc_id, k, arg_min(line, i) AS head, string_agg(line, chr(10) ORDER BY i) AS text FROM m GROUP BY doc_id, k)
SELECT 'doc_' || doc_id AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS page_number, CASE WHEN regexp_matches(head, '^##? ') THEN regexp_replace(head, '^#+ +', '') END AS section_title, text FROM p WHERE trim(text) <> ''""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with headings of both levels, a deeper one and an empty one planted around them."""
    text = F.concat(F.lit("# One\n"), F.substring("content", 1, 40), F.lit("\n## Two \n"), F.col("content"), F.lit("\n### no\n## \n  "))
    return files.markdown_sections(documents(spark, sf_dir).select(F.col("title").alias("path"), text.alias("text")))


@query("""
WITH n AS (SELECT n_nationkey AS o, 'n_name: ' || n_name || '; n_regionkey: ' || n_regionkey AS l FROM nation)
SELECT CAST(o // 20 AS INTEGER) + 1 AS page_number, string_agg(l, chr(10) ORDER BY o) AS text, (SELECT count(*) FROM n) AS total_rows FROM n GROUP BY 1""")
def csv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.csv_pages(spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey")


@query(f"WITH c AS ({FIXED_SQL}) SELECT c.doc_id || '_chunk_' || chunk_index AS chunk_id, c.doc_id, 'doc_' || c.doc_id AS title, source AS category, chunk_index, CAST(length(c.text) AS INTEGER) AS n_chars, replace(substr(c.text, 1, 200), chr(10), ' ') AS preview FROM c JOIN documents d USING (doc_id)")
def chunk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chunks = docs.select("doc_id", "title", "category", F.posexplode(C.fixed(F.col("content"))).alias("chunk_index", "text"))
    return files.export_chunks(chunks.withColumn("chunk_id", F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))))


@query(f"WITH c AS ({FIXED_SQL}) SELECT doc_id || '_chunk_' || chunk_index AS chunk_id, doc_id, md5(text) AS digest FROM c")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.continued_ids(chunk_fixed(spark, sf_dir), "doc_id", "chunk_index").select("chunk_id", "doc_id", F.md5("text").alias("digest"))
