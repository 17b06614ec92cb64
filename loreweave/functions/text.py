"""Text expressions: normal forms, counts, citations, masks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The circled numbers that mark citations.
MARKERS = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body and the lambdas in it refer to it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


# Unicode's white space, with the four separators that text tools count as such.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalise(text: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")


def no_letters_or_digits(text: Column) -> Column:
    """Only emoji, punctuation or white space."""
    return ~text.rlike(r"[一-鿿\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{ff00}-\x{ffef}a-zA-Z0-9]") | ~text.rlike(r"[\p{L}\p{N}]")


def emoji_runs(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"([\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]+)"), F.lit(1)))


def token_estimate(text: Column) -> Column:
    """Chinese characters at 1.5 to a token, others at 4."""
    # A text of as many bytes as characters is ASCII.
    chinese = F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.length(F.regexp_replace(text, "[^一-鿿]+", "")))
    return F.floor(chinese / F.lit(1.5) + (F.length(text) - chinese) / F.lit(4)).cast("int")


def occurrences(text: Column, word: Column) -> Column:
    """Times that word occurs, without overlaps. Bytes are counted, since for characters the text is gone through."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, word, F.lit("")))) / F.octet_length(word)).cast("int")


def strip_think(text: Column) -> Column:
    """Without thinking blocks, if both tags occur; trimmed."""
    both = F.lower(text).contains("<think>") & F.lower(text).contains("</think>")
    return strip(F.when(both, F.regexp_replace(text, r"(?is)<think>.*?</think>", "")).otherwise(text))


def split_think(text: Column) -> tuple[Column, Column]:
    """The thinking blocks, joined by line ends, and the answer without them."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<think>(.*?)</think>"), F.lit(1)), strip), "\n"), strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def align_citations(text: Column, n: Column) -> Column:
    """Markers numbered in order, superfluous ones cut, missing ones appended; n is taken as 20 at most."""
    n = F.least(n, F.lit(len(MARKERS)))
    marks = F.array(*map(F.lit, MARKERS))

    def numbered(parts: Column) -> Column:
        kept = F.transform(F.slice(parts, 2, F.size(parts)), lambda p, i: F.concat(F.when(i < n, F.get(marks, i)).otherwise(F.lit("")), p))
        missing = F.when(n > F.size(parts) - 1, F.array_join(F.slice(marks, F.size(parts), F.greatest(n - F.size(parts) + 1, F.lit(0))), "")).otherwise("")
        return F.concat(F.get(parts, 0), F.array_join(kept, ""), missing)

    # The markers are neighbours in Unicode; a range is one test for a character, a list is twenty.
    return bind(F.split(text, f"[{MARKERS[0]}-{MARKERS[-1]}]", -1), numbered)


def anonymous_ip(ip: Column) -> Column:
    """The last number of an IPv4 address as 0; other strings unchanged."""
    return F.regexp_replace(ip, r"^(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}$", "$1.0")


def cache_key(kb: Column, query: Column, options: dict[str, Column] | None = None) -> Column:
    parts = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in sorted((options or {}).items())]
    return F.md5(F.concat(kb, F.lit("::"), F.trim(query), F.lit("::"), F.concat_ws("|", *parts) if parts else F.lit("")))


def preview(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def one_line(text: Column, n: int) -> Column:
    return F.regexp_replace(F.substring(text, 1, n), r"\n", " ")


def citation(title: Column, authors: Column, year: Column, venue: Column, url: Column, kind: Column, doi: Column) -> Column:
    """A reference as one line; web sites end with their address, others with DOI or address."""
    text = lambda c: F.coalesce(c, F.lit(""))
    by = F.coalesce(F.nullif(F.array_join(authors, ", "), F.lit("")), F.lit("Anonymous"))
    when = text(F.concat(F.lit("("), year.cast("string"), F.lit(")")))
    site = F.concat(by, F.lit(". "), when, F.lit(" "), text(title), F.lit(". "), text(url))
    has_doi = text(doi) != ""
    tail = F.when(has_doi, F.concat(F.lit(" DOI: "), doi)).when(text(url) != "", F.concat(F.lit(" "), url)).otherwise("")
    other = F.concat(by, F.when(when != "", F.concat(F.lit(" "), when)).otherwise(""), F.lit(". "), text(title), F.lit(". "), text(venue), F.lit("."), tail)
    return strip(F.when(kind == "website", site).otherwise(other))


# Headings of the sections that models append to an answer.
TAILS = ("引用来源", "引用列表", "参考资料", "置信度评估", "置信度", "回答总结", "总结")


def strip_tails(text: Column) -> Column:
    """Without the sections behind such a heading on a line of its own, and without a closing rule."""
    for t in TAILS:
        text = F.regexp_replace(text, rf"\n\s*(?:\*\*|##+)?\s*{t}\s*[:：]\s*\n[\s\S]*$", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n-+\s*$", ""), r"\s+$", "")


def tag_name(tag: Column) -> Column:
    return F.lower(strip(tag))


def parse_iso(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1], F.lit(""))), values.items(), template)


def cut_at_first(text: Column, markers: list[str]) -> Column:
    """text up to the first marker, back to the last full stop before it."""
    places = [F.nullif(F.instr(text, F.lit(m)), F.lit(0)) for m in markers]
    at = F.least(*places) if len(places) > 1 else places[0]
    before = F.substr(text, F.lit(1), at - 1)
    return F.when(at.isNull(), text).otherwise(strip(F.regexp_extract(before, r"(?s)^(.*[。！？.!?])", 1)))


def json_object(text: Column) -> Column:
    """The widest {...} of an answer, if it parses."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull(), found)


# Placeholders that models leave in answers, and what stands for them.
PLACEHOLDERS = (r"\[object\s+\w+\]", "<undefined>", "<null>", "<empty>", r"\{\{[\w.\-]+\}\}", r"\$\{[\w.\-]+\}", r"(?<![\w<])undefined(?![\w>])", r"(?<![\w<])null(?![\w>])", r"\bNaN\b")
#: What a text must hold for each of them to match.
HELD_BY = ("[object", "<undefined>", "<null>", "<empty>", "{{", "${", "undefined", "null", "NaN")
ODD, USELESS = "（内容异常）", "（模型输出异常，请换个问法重试）"


def sanitise(text: Column) -> Column:
    """Placeholders, and runs of them, as one note; a text of nothing else as another. A pattern is only tried where a text holds what it needs."""
    for p, needs in [*zip(PLACEHOLDERS, HELD_BY, strict=True), (f"({ODD}){{2,}}", ODD + ODD)]:
        text = bind(text, lambda t, p=p, needs=needs: F.when(t.contains(needs), F.regexp_replace(t, p, ODD)).otherwise(t))
    return bind(text, lambda t: F.when(strip(t).isin(ODD, ""), USELESS).otherwise(t))


def collection_name(dim: Column) -> Column:
    return F.concat(F.lit("chunks_d"), dim.cast("string"))


# What is left of values that were no text, in texts that were put together from them.
STREAMED = r"\[object\s+\w+\]|<undefined>|<null>|<empty>"


def without_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, STREAMED, "")
