"""Chunkers against plain versions in Python."""

import re

import pytest
from pyspark.sql import functions as F

from loreweave.operators import chunking as C

TEXTS = [
    "", "   ", "short", "a" * 499, "b" * 500, "c" * 501, "d" * 900, "e" * 1000, "S1. S2. tail", "para one\n\npara two", "x. " * 400 + "tail", ("sentence number one! " * 30 + "\n\n") * 3 + "end",
    "# A\nx\n# B\ny", "# Head\n" + "line of text here\n" * 60, "第1章 开始\n内容。\n【标题】\n更多内容。", "前半句。" * 80 + "但是转折。" + "后半句。" * 100, "no end mark at all " * 50, "..a..b?!", " \n\n \n\nq",
]


def cut(spark, column):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    return [r["c"] for r in frame.select("k", column(F.col("t")).alias("c")).orderBy("k").collect()]


def packed(units, size, start=""):
    out, now = [], start
    for unit, width, forced in units:
        if not forced and len(now) + width < size:
            now += unit
        else:
            out.append(now)
            now = unit
    return [x.strip() for x in [*out, now] if x.strip()]


def ended(text):
    return [s for s in re.split("(?<=[。！？.!?])", text) if s and s[-1] in "。！？.!?"]


def test_fixed_windows(spark):
    for size, overlap in ((500, 100), (400, 0), (7, 3)):
        want = []
        for t in TEXTS:
            starts = [0] if t else []
            while starts and starts[-1] + size < len(t):
                starts.append(starts[-1] + size - overlap)
            want.append([c for c in (t[s : s + size].strip() for s in starts) if c])
        assert cut(spark, lambda t, s=size, o=overlap: C.fixed(t, s, o)) == want
    with pytest.raises(ValueError):
        C.fixed(F.lit("x"), 5, 5)


def test_sliding_windows(spark):
    assert cut(spark, C.naive) == [[t[i : i + 500] for i in range(0, len(t), 450)] for t in TEXTS]
    assert [len(c) for c in cut(spark, C.naive)][3:7] == [2, 2, 2, 2]


def test_recursive(spark):
    want = []
    for t in TEXTS:
        units = []
        for p in (p.strip() for p in t.split("\n\n")):
            if len(p) > 200:
                units += [("", 0, True), *((s, len(s), False) for s in ended(p))]
            elif p:
                units.append((p + "\n\n", len(p), False))
        want.append(packed(units, 200))
    got = cut(spark, lambda t: C.recursive(t, 200))
    assert got == want and got[16] == [] and got[9] == ["para one\n\npara two"]


def test_semantic_and_sentences(spark):
    want = []
    for t in TEXTS:
        out, now = [], ""
        for s in (s.strip() for s in ended(t)):
            if s and (len(now) > 100 and any(x in s[:10] for x in C.TRANSITIONS) or len(now) + len(s) >= 200):
                out.append(now)
                now = s
            else:
                now += s
        want.append([x for x in [*out, now] if x])
    assert cut(spark, lambda t: C.semantic(t, 200)) == want
    assert all(len(c) <= 60 or len(re.split("(?<=[。！？.!?])", c)) <= 2 for chunks in cut(spark, lambda t: C.sentences(t, 60)) for c in chunks)


def test_structure(spark):
    got = cut(spark, lambda t: C.structure(t, 300))
    assert got[12] == ["# A\nx", "# B\ny"] and got[14] == ["第1章 开始\n内容。", "【标题】\n更多内容。"]
    assert all(c.startswith("# Head\n") and len(c) < 330 for c in got[13]) and len(got[13]) > 3


def test_pages_rows_and_questions(spark):
    blocks = "\n\n".join("x" * 900 for _ in range(5))
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("c")).first()["c"]
    assert [len(p) for p in one(blocks, C.pages)] == [2704, 1802]
    assert one("1 2\n\n3 4", lambda t: C.rows_of_table(t, ["x", "y"])) == ["表格数据（列：x, y）\n1 2", "表格数据（列：x, y）\n3 4"]
    assert one("Q: a? A: b", C.questions) == ["Q: a?\nA: b"]
    assert one("k: v\nz: w", C.questions) == ["k: v", "z: w"]
    assert one("1. first\n2. second", C.questions) == ["1. first", "2. second"]
    assert one("|a|b|\n|-|-|\n|1|2|\nno", C.markdown_tables) == ["|a|b|\n|-|-|\n|1|2|"]


def test_overlap_tokens_and_parents(spark):
    rows = spark.createDataFrame([(1, 0, "abcdef"), (1, 1, "ghi"), (1, 2, "j"), (2, 0, "中文字abcd")], "d int, chunk_index int, text string")
    got = [r["text"] for r in C.with_overlap(rows, "d", 2, " ").orderBy("d", "chunk_index").collect()]
    assert got == ["abcdef", "ef ghi", "hi j", "中文字abcd"]
    assert C.with_tokens(rows).filter("d = 2").first()["token_count"] == 3
    docs = spark.createDataFrame([(1, "word " * 3000)], "d int, t string")
    children = C.parent_child(docs, "d", "t").collect()
    assert {r["parent_index"] for r in children} == {0, 1} and max(len(r["text"].split()) for r in children) == 512 + 39


MORE = [*TEXTS, "字" * 1700 + "。" + "词，" * 900, "w" * 3000, ("word " * 90 + "stop. ") * 9 + "\n" + "tail " * 700, "# A\n" + "word " * 60 + "\n# B\n" + "more " * 60 + "\n1. c\nshort", "\n\n".join("p" * n + " q" * n for n in range(40, 420, 60)), " " * 700]


def tokens(text):
    chinese = sum("\u4e00" <= c <= "\u9fff" for c in text)
    return int(chinese / 1.5 + (len(text) - chinese) / 4)


def go_down(text, level, size):
    """Plain version of the token-bounded cut, without overlap."""
    if not text.strip() or tokens(text) <= size:
        return [text] if text.strip() else []
    if level == len(C.BY_TOKENS):
        return [text]
    sep = C.BY_TOKENS[level]
    parts = text.split(sep) if sep else [text[i : i + 3 * size] for i in range(0, len(text), 3 * size)]
    out, group = [], []
    for part in [*parts, None]:
        if group and (part is None or sum(map(tokens, group)) + tokens(part) > size):
            out.append(sep.join(group))
            group = []
        if part is not None and tokens(part) > size:
            out += go_down(part, level + 1, size)
        elif part is not None:
            group.append(part)
    return out


def bounded(text, size, overlap):
    chunks = go_down(text, 0, size)
    return [c for c in ((chunks[i - 1][-3 * overlap :] + " " + c if i and overlap else c).strip() for i, c in enumerate(chunks)) if c]


def by_characters(text, level, size, overlap):
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    sep, out, now = C.BY_CHARACTERS[level], [], ""
    if not sep:
        out = [w for w in (text[i : i + size].strip() for i in range(0, len(text), size)) if w]
    for part in text.split(sep) if sep else []:
        part += sep if now else ""
        if len(now) + len(part) <= size:
            now += part
            continue
        out, now = [*out, now.strip()], part
        if len(part) > size:
            out, now = [*out, *by_characters(part, level + 1, size, overlap)], ""
    out = [c for c in [*out, now.strip()] if c]
    return [(out[i - 1][-overlap:] if i else "") + c for i, c in enumerate(out)]


def cut_more(spark, column):
    frame = spark.createDataFrame(list(enumerate(MORE)), "k int, t string")
    return [r["c"] for r in frame.select("k", column(F.col("t")).alias("c")).orderBy("k").collect()]


@pytest.mark.parametrize(("size", "overlap"), [(512, 64), (40, 4), (1536, 0)])
def test_token_bounded(spark, size, overlap):
    assert cut_more(spark, lambda t: C.token_bounded(t, size, overlap)) == [bounded(t, size, overlap) for t in MORE]


def test_by_separators(spark):
    for size, overlap in ((500, 50), (30, 7)):
        assert cut_more(spark, lambda t, s=size, o=overlap: C.by_separators(t, s, o)) == [by_characters(t, 0, size, overlap) for t in MORE]


def test_punctuated(spark):
    def plain(text, size=500, overlap=100):
        out, at = [], 0
        while at < len(text):
            window = text[at : at + size]
            places = [m.end() for m in re.finditer(r"[。？！\n]|\.(?= )", window)]
            if at + size < len(text) and places and places[-1] - 1 > size / 2:
                window = window[: places[-1]]
            out.append(window.strip())
            at += (len(window) if at + size < len(text) else size) - overlap
        return [c for c in out if c]

    assert cut_more(spark, C.punctuated) == [plain(t) for t in MORE]


def test_intelligent_sections(spark):
    def plain(text):
        cuts, head = [[None, ""]], re.compile(C.SECTION)
        for line in text.split("\n"):
            if head.match(line.strip()):
                cuts.append([line.strip(), ""])
            cuts[-1][1] += line + "\n"
        merged = []
        for title, body in (c for c in cuts if c[1].strip()):
            if merged and tokens(merged[-1][1]) < 50:
                merged[-1] = [merged[-1][0] or title, merged[-1][1] + "\n\n" + body]
            else:
                merged.append([title, body])
        return [(t, c) for t, body in merged for c in (bounded(body, 512, 64) if tokens(body) > 512 else [body.strip()])]

    frame = spark.createDataFrame(list(enumerate(MORE)), "k int, t string")
    rows = C.intelligent(frame, "k", "t").orderBy("k", "chunk_index").collect()
    assert [[(r["section_title"], r["text"]) for r in rows if r["k"] == k] for k in range(len(MORE))] == [plain(t) for t in MORE]


def test_parents_are_numbered_through(spark):
    frame = spark.createDataFrame(list(enumerate(MORE)), "k int, t string")
    rows = C.parent_child(frame, "k", "t").orderBy("k", "chunk_index").collect()
    want = [[(i, c) for i, p in enumerate(bounded(t, 1536, 0)) for c in bounded(p, 512, 64)] for t in MORE]
    assert [[(r["parent_index"], r["text"]) for r in rows if r["k"] == k] for k in range(len(MORE))] == want
    assert all(r["chunk_index"] == n for k in range(len(MORE)) for n, r in enumerate(x for x in rows if x["k"] == k))


def test_questions_fall_back_in_order(spark):
    def one(text):
        return spark.createDataFrame([(text,)], "t string").select(C.questions(F.col("t"))).first()[0]

    assert one("问：甲？答：乙。\nQuestion: x\nAnswer: y") == ["Q: 甲？\nA: 乙。", "Q: x\nA: y"]
    assert one("k : v ; z:w; none\n\n m: n:o") == ["k: v", "z: w", "m: n:o"]
    assert one("1、one two 2. three") == ["1、one two", "2. three"]
    assert one("plain words") == ["plain words"] and one("  ") == []


def test_strategies(spark):
    names = spark.createDataFrame([("book",), ("qa",), ("table",), ("?",)], "n string")
    assert [r[0] for r in names.select(C.strategy_of(F.col("n"))).collect()] == ["structure", "recursive", "fixed", "recursive"]
    docs = spark.createDataFrame([(1, "a", "x" * 10), (2, "b", "# H\ny")], "d int, category string, t string")
    got = {(r["d"], r["text"]) for r in C.by_category(docs, "d", "t", {"a": ("fixed", 4, 0), "b": ("paper", 50, 0)}).collect()}
    assert got == {(1, "xxxx"), (1, "xx"), (2, "# H\ny")}
