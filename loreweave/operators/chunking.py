"""Chunkers: expressions from a text to an array of chunks, and the table of chunks.

Windows come from a sequence of starts. Greedy packers fold over the units of a
text inside the row, so no line or sentence is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import WHITE_SPACE, bind, strip, token_estimate

NONE = "array<string>"
END = "[。！？.!?]"
# Fixed values of the chunkers.
HEADING = r"^(?:#{1,6}\s+.+|【.+?】|第[一二三四五六七八九十\d]+[章节].*)$"
TRANSITIONS = ("但是", "然而", "另一方面", "此外", "同时", "另外", "其次", "首先", "最后")
ALIASES = {
    "auto": "recursive", "naive": "fixed", "general": "recursive", "intelligent": "structure", "parent_child": "recursive",
    "book": "structure", "paper": "structure", "resume": "structure", "qa": "recursive", "table": "fixed",
}
# Separators, from the coarsest to single characters, of the two chunkers that go down level by level.
BY_TOKENS = ("\n\n", "\n", ". ", "；", "。", " ", "")
BY_CHARACTERS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")
SECTION = r"^(#{1,6}\s+.+|第[一二三四五六七八九十\d]+[章节部分].+|[一二三四五六七八九十\d]+[、\.]\s*.+)$"
PAIR = r"(?is)(?:Q|问|Question)[:：\s]+(.+?)(?:A|答|Answer)[:：\s]+(.+?)(?=(?:Q|问|Question)[:：]|$)"
ITEM = r"(?s)(\d+[、\.]\s*.+?)(?=\d+[、\.]|$)"
PAPER_SECTIONS = (
    "abstract", "摘要", "introduction", "引言", "绪论", "related work", "相关工作", "methodology", "方法", "方法论", "experiment", "实验", "result", "结果",
    "discussion", "讨论", "conclusion", "结论", "reference", "参考文献", "acknowledgment", "致谢",
)
RESUME_SECTIONS = (
    "个人信息", "基本信息", "personal", "contact", "教育背景", "教育经历", "education", "工作经历", "工作经验", "experience", "employment",
    "项目经验", "项目经历", "project", "技能", "专业技能", "skill", "证书", "资格证书", "certificate", "自我评价", "summary", "objective",
)
BASE_STRATEGIES, MORE_STRATEGIES = ("fixed", "recursive", "structure", "semantic"), ("naive", "general", "recursive", "intelligent", "parent_child", "book", "paper", "resume", "qa", "table")


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")


#: Windows up to this width are cut in one pass over a text; a window by its place is found by going through what lies before it.
ONE_PASS = 2000


def _windows(text: Column, n: Column, step: int, width: int) -> Column:
    if width <= ONE_PASS:
        cut = F.slice(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{width}}})).{{1,{step}}}"), F.lit(1)), F.lit(1), n)
    else:
        cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * step + 1, F.lit(width)))
    return F.when(n > 0, cut).otherwise(F.array().cast(NONE))


def _trimmed(window: Column) -> Column:
    """strip, which goes through a whole text to trim its end, only where that end is blank."""
    return F.when(F.instr(F.lit(WHITE_SPACE), F.substr(window, F.lit(-1), F.lit(1))) > 0, strip(window)).otherwise(F.ltrim(window, F.lit(WHITE_SPACE)))


def fixed(text: Column, size: int = 500, overlap: int = 100) -> Column:
    """Windows of size that share overlap; the last one ends with the text. Trimmed, blank ones dropped."""
    _check(size, overlap)
    step, length = size - overlap, F.length(text)
    n = F.when(length == 0, 0).when(length <= size, 1).otherwise((1 + F.ceil((length - size) / F.lit(step))).cast("int"))
    return F.filter(F.transform(_windows(text, n, step, size), _trimmed), lambda c: c != "")


def sliding(text: Column, width: int, step: int) -> Column:
    """Windows from every multiple of step below the length, tails included."""
    return _windows(text, F.ceil(F.length(text) / F.lit(step)).cast("int"), step, width)


def naive(text: Column, size: int = 500, overlap: int = 50) -> Column:
    _check(size, overlap)
    return sliding(text, size, size - overlap)


def general(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of three characters to a token."""
    _check(size, overlap)
    return sliding(text, 3 * size, 3 * (size - overlap))


def terminated(text: Column) -> Column:
    """Sentences with their end marks; a rest without one is dropped."""
    return F.filter(F.split(text, f"(?<={END})", -1), lambda s: s.rlike(f"{END}$"))


def _fold(units: Column, step: Callable[[Column, Column], Column], more: dict[str, Column] | None = None) -> Column:
    """Chunks of a fold over units; step gives the state's new fields (open, done and more)."""
    start = F.struct(F.lit("").alias("open"), F.array().cast(NONE).alias("done"), *(v.alias(k) for k, v in (more or {}).items()))
    return F.aggregate(units, start, step, lambda s: _flush(s["done"], s["open"]))


def _flush(done: Column, chunk: Column) -> Column:
    return F.when(strip(chunk) != "", F.array_append(done, strip(chunk))).otherwise(done)


def _pack(state: Column, fits: Column, longer: Column, fresh: Column) -> Column:
    return F.struct(F.when(fits, longer).otherwise(fresh).alias("open"), F.when(fits, state["done"]).otherwise(_flush(state["done"], state["open"])).alias("done"))


def recursive(text: Column, size: int = 500) -> Column:
    """Paragraphs packed below size; longer ones sentence by sentence, of which an unterminated rest is dropped."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    unit = lambda t, force: F.struct(t.alias("text"), force.alias("force"))
    nothing = F.array(unit(F.lit(""), F.lit(True)))
    sentences = lambda p: F.concat(nothing, F.transform(terminated(p), lambda s: unit(s, F.lit(False))))
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > size, sentences(p)).otherwise(F.array(unit(F.concat(p, F.lit("\n\n")), F.lit(False))))))
    bare = lambda u: F.length(F.regexp_replace(u["text"], "\n\n$", ""))
    return _fold(units, lambda s, u: _pack(s, ~u["force"] & (F.length(s["open"]) + bare(u) < size), F.concat(s["open"], u["text"]), u["text"]))


def structure(text: Column, size: int = 500) -> Column:
    """A heading opens a chunk; what overflows begins with its section's heading again."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")

    def step(s: Column, line: Column) -> Column:
        head = line.rlike(HEADING)
        fits = ~head & (F.length(s["open"]) + F.length(line) < size)
        again = F.when(s["section"] != "", F.concat(s["section"], F.lit("\n"))).otherwise("")
        fresh = F.concat(F.when(head, F.lit("")).otherwise(again), line, F.lit("\n"))
        packed = _pack(s, fits, F.concat(s["open"], line, F.lit("\n")), fresh)
        return F.struct(packed["open"].alias("open"), packed["done"].alias("done"), F.when(head, line).otherwise(s["section"]).alias("section"))

    return _fold(lines, step, {"section": F.lit("")})


def semantic(text: Column, size: int = 500) -> Column:
    """Terminated sentences packed below size, and cut before a transition once a chunk is over half full."""
    sentences = F.filter(F.transform(terminated(text), strip), lambda x: x != "")

    def step(s: Column, u: Column) -> Column:
        turn = (F.length(s["open"]) > 0.5 * size) & F.substring(u, 1, 10).rlike("|".join(TRANSITIONS))
        return _pack(s, ~turn & (F.length(s["open"]) + F.length(u) < size), F.concat(s["open"], u), u)

    return _fold(sentences, step)


def sentences(text: Column, size: int = 500) -> Column:
    """Sentences, with their rest, packed up to size."""
    units = F.filter(F.split(text, r"(?<=[。！？.!?])\s*"), lambda x: strip(x) != "")
    return _fold(units, lambda s, u: _pack(s, F.length(s["open"]) + F.length(u) <= size, F.concat(s["open"], u), u))


def pages(text: Column, least: int = 2000) -> Column:
    """Text pages: blocks between blank lines, gathered until they have least characters."""
    blocks = F.filter(F.transform(F.split(text, r"\n[\x20\t]*\n"), strip), lambda x: x != "")

    def step(s: Column, b: Column) -> Column:
        joined = F.when(s["open"] == "", b).otherwise(F.concat(s["open"], F.lit("\n\n"), b))
        size = s["size"] + F.length(b)
        full = size >= least
        return F.struct(F.when(full, F.lit("")).otherwise(joined).alias("open"), F.when(full, F.array_append(s["done"], joined)).otherwise(s["done"]).alias("done"), F.when(full, F.lit(0)).otherwise(size).alias("size"))

    return _fold(blocks, step, {"size": F.lit(0)})


def rows_of_table(text: Column, headers: list[str]) -> Column:
    """One chunk for each line with text, behind the names of the columns."""
    head = F.lit("表格数据（列：" + ", ".join(headers) + "）\n")
    return F.transform(F.filter(F.split(strip(text), "\n"), lambda x: strip(x) != ""), lambda x: F.concat(head, x))


def markdown_tables(text: Column) -> Column:
    """Tables with a line of dashes under their head, trimmed.

    A table is a head, which may begin behind other words of its line, a line of
    dashes and at least one row; it ends before the first line that isn't between
    bars, and every line of it has its line end. The dashes are one line. Lines are marked one by one and cut
    where runs of them end, so a table of any length is found.
    """
    bare = lambda e: F.rtrim(e, F.lit("\r\n"))
    closed = lambda e: e.rlike(r"[\r\n]$") & bare(e).endswith("|")
    is_row = lambda e: closed(e) & e.startswith("|") & (F.length(bare(e)) > 2)
    is_head = lambda e: closed(e) & (F.length(bare(e)) - F.instr(e, F.lit("|")) >= 2)
    is_dashes = lambda e: bare(e).rlike(r"^\|[-:\s|]+\|$")

    def cut(lines: Column, breaks: Column) -> Column:
        def first_table(k: Column) -> Column:
            """The table between a break, whose line may be a head, and the next."""
            start = F.greatest(F.get(breaks, k), F.lit(0))
            n = F.get(breaks, k + 1) - start

            def found(part: Column) -> Column:
                at = F.filter(F.sequence(F.lit(0), F.size(part) - 3), lambda i: is_dashes(F.get(part, i + 1)) & is_head(F.get(part, i)))
                head = bind(F.get(part, F.get(at, 0)), lambda e: F.substr(e, F.instr(e, F.lit("|"))))
                return F.when(F.size(at) > 0, strip(F.concat(head, F.array_join(F.slice(part, F.get(at, 0) + 2, F.size(part)), ""))))

            return F.when(n >= 3, bind(F.slice(lines, start + 1, n), found))

        return F.array_compact(F.transform(F.sequence(F.lit(0), F.size(breaks) - 2), first_table))

    marks = lambda lines: F.transform(lines, lambda e, i: F.when(~is_row(e), i))
    whole = lambda lines: bind(F.concat(F.array(F.lit(-1)), F.array_compact(marks(lines)), F.array(F.size(lines))), lambda b: cut(lines, b))
    return F.when(text.contains("|"), bind(F.split(text, r"(?<=[\r\n])(?=[^\r\n])"), whole)).otherwise(F.array().cast(NONE))


def table(text: Column, headers: list[str] | None = None) -> Column:
    """Rows behind the names of the columns; without names the Markdown tables, and without any the text as it is."""
    if headers:
        return rows_of_table(text, headers)
    return bind(markdown_tables(text), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(text)))


def questions(text: Column) -> Column:
    """Question and answer pairs; else key: value between line ends and semicolons; else numbered items; else the whole text."""
    asked, answered = (F.regexp_extract_all(text, F.lit(PAIR), F.lit(g)) for g in (1, 2))
    pairs = F.transform(F.arrays_zip(asked.alias("q"), answered.alias("a")), lambda p: F.concat(F.lit("Q: "), strip(p["q"]), F.lit("\nA: "), strip(p["a"])))

    def value(part: Column) -> Column:
        name = F.substring_index(part, ":", 1)
        rest = strip(F.substr(part, F.length(name) + 2))
        return F.when(part.contains(":") & (strip(name) != "") & (rest != ""), F.concat(strip(name), F.lit(": "), rest))

    values = F.array_compact(F.transform(F.split(text, "[\n;]"), value))
    items = F.transform(F.regexp_extract_all(text, F.lit(ITEM), F.lit(1)), strip)
    found = F.transform(F.array(F.struct(pairs.alias("p"), values.alias("v"), items.alias("i"))), lambda x: F.when(F.size(x["p"]) > 0, x["p"]).when(F.size(x["v"]) > 0, x["v"]).when(F.size(x["i"]) > 0, x["i"]).otherwise(F.filter(F.array(text), lambda t: strip(t) != "")))
    return F.get(found, 0)


def is_title(line: Column) -> Column:
    """A chapter heading, or a short line that doesn't end a sentence."""
    short = (F.length(line) < 50) & ~line.rlike(r"[。！？.!?,，;；:：]$")
    return line.rlike(r"^(?:第[一二三四五六七八九十百\d]+[章节回]|Chapter\s+\d+|#{1,6}\s)") | short


def exploded(docs: DataFrame, key: str, chunks: Column) -> DataFrame:
    """key, chunk_index, text."""
    return docs.select(key, F.posexplode(chunks).alias("chunk_index", "text"))


def sections(docs: DataFrame, key: str, text: str, starts: Callable[[Column], Column], least: int) -> DataFrame:
    """key, section, text: lines from one that starts a section to the next; those of least characters or fewer are dropped."""
    lines = docs.select(key, F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "").alias("_l"))
    at = F.filter(F.transform("_l", lambda x, i: F.when(starts(x) | (i == 0), i)), lambda i: i.isNotNull())
    lines = lines.withColumn("_at", at)
    until = lambda k: F.coalesce(F.get(F.col("_at"), k + 1), F.size("_l"))
    cut = F.transform("_at", lambda a, k: F.array_join(F.slice(F.col("_l"), a + 1, until(k) - a), "\n"))
    return lines.select(key, F.posexplode(F.when(F.size("_l") > 0, cut)).alias("section", "text")).filter(F.length("text") > least)


def has_keyword(line: Column, words: tuple[str, ...], below: int) -> Column:
    """Whether a line of fewer than below characters holds one of the words, whatever its case."""
    return (F.length(line) < below) & F.lower(line).rlike("|".join(words))


def filled_sections(text: Column, starts: Callable[[Column], Column], most: int, least: int) -> Column:
    """array<struct<title, text>>: lines from one that starts a section to the next, or until their lengths pass most.

    What stands behind such a cut keeps the section's title. Sections of least
    characters or fewer are dropped, unless they were cut.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    chunk = lambda s: F.struct(s["title"].alias("title"), s["open"].alias("text"))
    nothing = F.array().cast("array<struct<title:string,text:string>>")
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("title"), nothing.alias("done"))

    def closed(s: Column) -> Column:
        return F.when(F.length(s["open"]) > least, F.array_append(s["done"], chunk(s))).otherwise(s["done"])

    def step(s: Column, line: Column) -> Column:
        longer = F.when(s["open"] == "", line).otherwise(F.concat(s["open"], F.lit("\n"), line))
        size = s["size"] + F.length(line)
        cut = F.array_append(s["done"], F.struct(s["title"].alias("title"), longer.alias("text")))
        state = lambda o, n, t, d: F.struct(o.alias("open"), n.alias("size"), t.alias("title"), d.alias("done"))
        return F.when(starts(line), state(line, F.length(line), line, closed(s))).when(size > most, state(F.lit(""), F.lit(0), s["title"], cut)).otherwise(state(longer, size, s["title"], s["done"]))

    return F.aggregate(lines, start, step, closed)


def book(text: Column, size: int = 512) -> Column:
    """Chapters of more than 100 characters, cut when they pass three times size."""
    return filled_sections(text, is_title, max(3 * size, 1500), 100)


#: Longer than any text: a section that isn't cut.
_NEVER = 2_000_000_000


def paper(text: Column) -> Column:
    return filled_sections(text, lambda x: has_keyword(x, PAPER_SECTIONS, 100), _NEVER, 50)


def resume(text: Column) -> Column:
    return filled_sections(text, lambda x: has_keyword(x, RESUME_SECTIONS, 50), _NEVER, 20)


def question_titles(chunks: Column) -> Column:
    """array<struct<title, text>>: pairs with the first 50 characters of their question."""
    title = lambda c: F.nullif(F.substring(F.regexp_extract(c, r"(?s)^Q: (.*?)\nA: ", 1), 1, 50), F.lit(""))
    return F.transform(chunks, lambda c: F.struct(title(c).alias("title"), c.alias("text")))


def _untitled(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: F.struct(F.lit(None).cast("string").alias("title"), c.alias("text")))


#: Strategy to what cuts a text into titled chunks, given size and overlap.
STRATEGIES: dict[str, Callable[[Column, int, int], Column]] = {
    "fixed": lambda t, size, overlap: _untitled(fixed(t, size, overlap)),
    "naive": lambda t, size, overlap: _untitled(naive(t, size, overlap)),
    "general": lambda t, size, overlap: _untitled(general(t, size, overlap)),
    "recursive": lambda t, size, overlap: _untitled(token_bounded(t, size, overlap)),
    "structure": lambda t, size, overlap: _untitled(structure(t, size)),
    "semantic": lambda t, size, overlap: _untitled(semantic(t, size)),
    "intelligent": lambda t, size, overlap: intelligent_chunks(t, size, overlap),
    "parent_child": lambda t, size, overlap: F.transform(children(t, 3 * size, size, overlap), lambda c: F.struct(F.lit(None).cast("string").alias("title"), c["text"].alias("text"))),
    "book": lambda t, size, overlap: book(t, size),
    "paper": lambda t, size, overlap: paper(t),
    "resume": lambda t, size, overlap: resume(t),
    "qa": lambda t, size, overlap: question_titles(questions(t)),
    "table": lambda t, size, overlap: _untitled(table(t)),
}


def strategies() -> list[str]:
    """All strategies' names in their order, each once."""
    return list(dict.fromkeys(BASE_STRATEGIES + MORE_STRATEGIES))


def chunk_pages(pages: DataFrame, key: str, strategy: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """key, chunk_index, page_number, section_title, text, token_count of pages (key, page_number, section_title, text).

    chunk_index runs on over the pages of a document. A chunk without a title of
    its own has its page's. Unknown strategies raise an error.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy}; there are {', '.join(STRATEGIES)}")
    cut = pages.select(key, "page_number", "section_title", F.coalesce(STRATEGIES[strategy](F.coalesce("text", F.lit("")), size, overlap), F.array().cast("array<struct<title:string,text:string>>")).alias("_c"))
    before = Window.partitionBy(key).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_from", F.coalesce(F.sum(F.size("_c")).over(before), F.lit(0)))
    rows = placed.select(key, "page_number", "section_title", "_from", F.posexplode("_c").alias("_n", "_c"))
    found = rows.select(key, (F.col("_from") + F.col("_n")).cast("int").alias("chunk_index"), "page_number", F.coalesce("_c.title", "section_title").alias("section_title"), F.col("_c.text").alias("text"))
    return found.withColumn("token_count", token_estimate(F.col("text")))


def chunk_table_pages(pages: DataFrame, key: str) -> DataFrame:
    """key, chunk_index, page_number, section_title, text, token_count, kind of pages (key, page_number, section_title, text, headers).

    A page with headers is a sheet: each line with text is a row behind their names,
    titled by its number. Of other pages each Markdown table is a chunk, titled by
    its place on the page; a page without one is a chunk as it is, under its own title.
    chunk_index runs on over the pages of a document, and so do the numbers of rows.
    """
    sheet = F.coalesce(F.size("headers") > 0, F.lit(False))
    content = F.coalesce("text", F.lit(""))
    names = F.concat(F.lit("表格数据（列："), F.array_join("headers", ", "), F.lit("）\n"))
    lines = F.filter(F.split(strip(content), "\n"), lambda x: strip(x) != "")
    rows = F.transform(lines, lambda x: F.concat(names, x))
    found = pages.select(key, "page_number", "section_title", F.when(sheet, "table_row").alias("kind"), F.when(sheet, rows).otherwise(markdown_tables(content)).alias("_c"), content.alias("_page"))
    whole = F.col("kind").isNull() & (F.size("_c") == 0)
    found = found.withColumns({"kind": F.when(whole, "page").otherwise(F.coalesce("kind", F.lit("table"))), "_c": F.when(whole, F.array("_page")).otherwise(F.col("_c"))}).drop("_page")
    before = Window.partitionBy(key).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("_from", F.coalesce(F.sum(F.size("_c")).over(before), F.lit(0))).select(key, "page_number", "section_title", "kind", "_from", F.posexplode("_c").alias("_n", "text"))
    place = (F.col("_from") + F.col("_n")).cast("int")
    title = F.when(F.col("kind") == "table_row", F.concat(F.lit("数据行 "), (place + 1).cast("string"))).when(F.col("kind") == "table", F.concat(F.lit("Table "), (F.col("_n") + 1).cast("string"))).otherwise(F.col("section_title"))
    return placed.select(key, place.alias("chunk_index"), "page_number", title.alias("section_title"), "text", token_estimate(F.col("text")).alias("token_count"), "kind")


def chunk_texts(docs: DataFrame, key: str, text: str, strategy: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """chunk_pages of whole texts, each one page."""
    pages = docs.select(key, F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("section_title"), F.col(text).alias("text"))
    return chunk_pages(pages, key, strategy, size, overlap)


def with_overlap(chunks: DataFrame, key: str, n: int, joiner: str = "") -> DataFrame:
    """Every chunk behind the last n characters of the one before it."""
    before = F.lag("text").over(Window.partitionBy(key).orderBy("chunk_index"))
    tail = F.when(F.length(before) > n, F.substr(before, F.length(before) - n + 1)).otherwise(before)
    return chunks.withColumn("text", F.when(before.isNull(), F.col("text")).otherwise(F.concat(tail, F.lit(joiner), F.col("text"))))


def punctuated(text: Column, size: int = 500, overlap: int = 100) -> Column:
    """Windows of size, cut behind the last end mark or line end in their second half; the next one starts overlap characters before the end."""
    _check(size, 2 * overlap)
    least, half = size // 2 + 2 - overlap, size * 0.5

    def step(length: Column, s: Column) -> Column:
        def placed(window: Column) -> Column:
            cut = F.length(F.regexp_extract(window, r"(?s)^(.*(?:[。？！\n]|\.(?= )))", 1))
            n = F.when((s["at"] + size < length) & (cut - 1 > half), cut).otherwise(F.lit(size))
            return bind(n, lambda k: F.struct((s["at"] + k - overlap).alias("at"), _flush(s["done"], F.substr(window, F.lit(1), k)).alias("done")))

        return F.when(s["at"] < length, bind(F.substr(text, s["at"] + 1, F.lit(size)), placed)).otherwise(s)

    start = F.struct(F.lit(0).alias("at"), F.array().cast(NONE).alias("done"))
    return bind(F.length(text), lambda n: F.aggregate(F.sequence(F.lit(0), F.ceil(n / F.lit(least)).cast("int")), start, lambda s, _: step(n, s), lambda s: s["done"]))


def _split_at(text: Column, separator: str, width: int) -> Column:
    """text between separators, or windows of width if the separator is empty."""
    if separator:
        return F.split(text, f"\\Q{separator}\\E", -1)
    return _windows(text, F.ceil(F.length(text) / F.lit(width)).cast("int"), width, width)


_UNITS = "array<struct<text:string,long:boolean>>"


def _unit(text: Column, long: Column) -> Column:
    return F.struct(text.alias("text"), long.alias("long"))


def _gathered(text: Column, separator: str, size: int) -> Column:
    """Units of a long text: parts gathered up to size tokens, and parts that are longer on their own."""
    parts = F.transform(_split_at(text, separator, 3 * size), lambda p: F.struct(p.alias("text"), token_estimate(p).alias("n")))
    start = F.struct(F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"), F.array().cast(_UNITS).alias("done"))
    closed = lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], _unit(s["open"], F.lit(False))))

    def step(s: Column, p: Column) -> Column:
        long, more = p["n"] > size, s["n"] + p["n"]
        alone = F.when(strip(p["text"]) == "", closed(s)).otherwise(F.array_append(closed(s), _unit(p["text"], F.lit(True))))
        full = more > size
        return F.struct(
            F.when(long, F.lit(None)).when(full | s["open"].isNull(), p["text"]).otherwise(F.concat(s["open"], F.lit(separator), p["text"])).alias("open"),
            F.when(long, 0).when(full, p["n"]).otherwise(more).alias("n"),
            F.when(long, alone).when(full, closed(s)).otherwise(s["done"]).alias("done"),
        )

    return F.aggregate(parts, start, step, closed)


def token_bounded(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Chunks of about size tokens, each behind the end of the one before it, three characters to a token of overlap.

    Level by level of BY_TOKENS, what is still too long is split at the next
    separator and gathered again; what a level has gathered stays.
    """
    units = F.filter(F.array(_unit(text, token_estimate(text) > size)), lambda u: strip(u["text"]) != "")

    def at(separator: str) -> Callable[[Column], Column]:
        return lambda u: F.when(u["long"], _gathered(u["text"], separator, size)).otherwise(F.array(u))

    for separator in BY_TOKENS:
        units = F.flatten(F.transform(units, at(separator)))
    if not overlap:
        return F.filter(F.transform(units, lambda u: strip(u["text"])), lambda c: c != "")

    def behind(plain: Column) -> Column:
        before = lambda i: F.right(F.get(plain, i - 1)["text"], F.lit(3 * overlap))
        return F.transform(plain, lambda u, i: strip(F.when(i > 0, F.concat(before(i), F.lit(" "), u["text"])).otherwise(u["text"])))

    return F.filter(bind(units, behind), lambda c: c != "")


_PLACED = "array<struct<text:string,long:boolean,path:array<int>>>"


def _packed(text: Column, path: Column, separator: str, size: int) -> Column:
    """Units of a long text: parts with their separators packed up to size, and parts that are longer on their own."""
    unit = lambda t, long: F.struct(t.alias("text"), F.lit(long).alias("long"), path.alias("path"))
    closed = lambda s: F.when(strip(s["open"]) == "", s["done"]).otherwise(F.array_append(s["done"], unit(strip(s["open"]), False)))
    if not separator:
        windows = F.filter(F.transform(_split_at(text, "", size), strip), lambda w: w != "")
        return F.transform(windows, lambda w: unit(w, False))

    def step(s: Column, part: Column) -> Column:
        def taken(p: Column) -> Column:
            fits, long = s["n"] + p["n"] <= size, p["n"] > size
            return F.struct(
                F.when(fits, F.concat(s["open"], p["text"])).when(long, F.lit("")).otherwise(p["text"]).alias("open"),
                F.when(fits, s["n"] + p["n"]).when(long, 0).otherwise(p["n"]).alias("n"),
                F.when(fits, s["done"]).when(long, F.array_append(closed(s), unit(p["text"], True))).otherwise(closed(s)).alias("done"),
            )

        ended = F.when(s["n"] == 0, part).otherwise(F.concat(part, F.lit(separator)))
        return bind(bind(ended, lambda t: F.struct(t.alias("text"), F.length(t).alias("n"))), taken)

    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("n"), F.array().cast(_PLACED).alias("done"))
    return F.aggregate(_split_at(text, separator, size), start, step, closed)


def by_separators(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Chunks of up to size characters, packed level by level of BY_CHARACTERS.

    What is still too long goes down a level; path lists the texts that a chunk
    was cut from. Deepest first, the chunks of each such text get the end of the
    one before. A run without any separator is cut into windows, none of it lost.
    """
    first = F.struct(text.alias("text"), (F.length(text) > size).alias("long"), F.array().cast("array<int>").alias("path"))
    units = F.filter(F.array(first), lambda u: strip(u["text"]) != "")
    units = F.transform(units, lambda u: F.struct(F.when(u["long"], u["text"]).otherwise(strip(u["text"])).alias("text"), u["long"].alias("long"), u["path"].alias("path")))

    def at(separator: str) -> Callable[[Column, Column], Column]:
        return lambda u, i: F.when(u["long"], _packed(u["text"], F.array_append(u["path"], i), separator, size)).otherwise(F.array(u))

    for separator in BY_CHARACTERS:
        units = F.flatten(F.transform(units, at(separator)))

    def joined(level: int) -> Callable[[Column], Column]:
        def one(chunks: Column, u: Column, i: Column) -> Column:
            before = F.get(chunks, i - 1)
            same = (i > 0) & (F.get(u["path"], level) == F.get(before["path"], level))
            return F.struct(F.when(same, F.concat(F.right(before["text"], F.lit(overlap)), u["text"])).otherwise(u["text"]).alias("text"), u["path"].alias("path"))

        return lambda chunks: F.transform(chunks, lambda u, i: one(chunks, u, i))

    for level in reversed(range(len(BY_CHARACTERS) if overlap else 0)):
        units = bind(units, joined(level))
    return F.transform(units, lambda u: u["text"])


def children(text: Column, parent: int = 1536, child: int = 512, overlap: int = 64) -> Column:
    """array<struct<parent_index, text>>: children cut from parents without overlap; sizes in tokens."""
    cut = lambda p, i: F.transform(token_bounded(p, child, overlap), lambda c: F.struct(i.alias("parent_index"), c.alias("text")))
    return bind(token_bounded(text, parent, 0), lambda parents: F.flatten(F.transform(parents, cut)))


def parent_child(docs: DataFrame, key: str, text: str, parent: int = 1536, child: int = 512, overlap: int = 64) -> DataFrame:
    """key, chunk_index, parent_index, text: children, numbered through."""
    return docs.select(key, F.posexplode(children(F.col(text), parent, child, overlap)).alias("chunk_index", "_c")).select(key, "chunk_index", "_c.parent_index", "_c.text")


_SECTIONS = "array<struct<title:string,text:string>>"


def headed_sections(text: Column) -> Column:
    """array<struct<title, text>>: lines from a heading to the next one, each with its line end; blank sections dropped."""
    start = F.struct(F.lit(None).cast("string").alias("title"), F.lit("").alias("text"), F.array().cast(_SECTIONS).alias("done"))
    closed = lambda s: F.when(strip(s["text"]) == "", s["done"]).otherwise(F.array_append(s["done"], F.struct(s["title"].alias("title"), s["text"].alias("text"))))

    def step(s: Column, line: Column) -> Column:
        head, ended = strip(line).rlike(SECTION), F.concat(line, F.lit("\n"))
        return F.struct(
            F.when(head, strip(line)).otherwise(s["title"]).alias("title"),
            F.when(head, ended).otherwise(F.concat(s["text"], ended)).alias("text"),
            F.when(head, closed(s)).otherwise(s["done"]).alias("done"),
        )

    return F.aggregate(F.split(text, "\n", -1), start, step, closed)


def merged_sections(sections: Column, least: int = 50) -> Column:
    """Sections below least tokens take in the ones that follow; a merged one has the first title that it meets."""
    start = F.array().cast(_SECTIONS)

    def step(done: Column, s: Column) -> Column:
        def added(last: Column) -> Column:
            both = F.struct(F.coalesce(last["title"], s["title"]).alias("title"), F.concat(last["text"], F.lit("\n\n"), s["text"]).alias("text"))
            grown = F.array_append(F.slice(done, 1, F.size(done) - 1), both)
            return F.when(token_estimate(last["text"]) < least, grown).otherwise(F.array_append(done, s))

        return F.when(F.size(done) == 0, F.array(s)).otherwise(bind(F.get(done, F.size(done) - 1), added))

    return F.aggregate(sections, start, step)


def intelligent_chunks(text: Column, size: int = 512, overlap: int = 64, least: int = 50) -> Column:
    """array<struct<title, text>>: merged sections, the long ones cut to size tokens. Blank texts have none."""
    cut = lambda s: F.when(token_estimate(s["text"]) > size, token_bounded(s["text"], size, overlap)).otherwise(F.array(strip(s["text"])))
    titled = lambda s: F.transform(cut(s), lambda c: F.struct(s["title"].alias("title"), c.alias("text")))
    return bind(merged_sections(headed_sections(text), least), lambda found: F.flatten(F.transform(found, titled)))


def intelligent(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 64, least: int = 50) -> DataFrame:
    """key, chunk_index, section_title, text of intelligent_chunks."""
    chunks = intelligent_chunks(F.col(text), size, overlap, least)
    return docs.select(key, F.posexplode(chunks).alias("chunk_index", "_c")).select(key, "chunk_index", F.col("_c.title").alias("section_title"), "_c.text")


#: Strategy to the expression that cuts a text.
CHUNKERS: dict[str, Callable[..., Column]] = {"fixed": fixed, "recursive": lambda t, size, overlap: recursive(t, size), "structure": lambda t, size, overlap: structure(t, size), "semantic": lambda t, size, overlap: semantic(t, size)}


def strategy_of(name: Column) -> Column:
    """The algorithm behind a strategy's name; recursive for unknown ones."""
    aliases = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.coalesce(F.element_at(aliases, name), F.when(name.isin(list(CHUNKERS)), name), F.lit("recursive"))


def by_category(docs: DataFrame, key: str, text: str, configured: dict[str, tuple[str, int, int]], default: tuple[str, int, int] = ("recursive", 500, 100)) -> DataFrame:
    """key, chunk_index, text, by the strategy, size and overlap of each document's category."""
    chunks = None
    for category, (strategy, size, overlap) in configured.items():
        cut = CHUNKERS.get(ALIASES.get(strategy, strategy), CHUNKERS["recursive"])(F.col(text), size, overlap)
        chunks = F.when(F.col("category") == category, cut) if chunks is None else chunks.when(F.col("category") == category, cut)
    rest = CHUNKERS[default[0]](F.col(text), *default[1:])
    return exploded(docs, key, rest if chunks is None else chunks.otherwise(rest))


def with_tokens(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("token_count", token_estimate(F.col("text")))
