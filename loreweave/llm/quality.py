"""Quality rules: a table of thresholds, compiled into one Spark projection.

A rule is a ratio of two counts and the bounds it may have. The counts are
Spark expressions over a text and its words; no user function is involved.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, words_of

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were which will with you not have had but they "
    "au aux avec ce ces dans de des du elle en est et il la le les leur ne par pas pour que qui sur un une "
    "als auch auf aus das dem den der des die ein eine er es für im in ist mit nicht sich sie und von zu "
    "al como con del el en es esta la las lo los más no para pero por que se su un una y o"
)


@dataclass(frozen=True)
class Rule:
    """low * whole <= part <= high * whole, both names of counts; a bound of None is none."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        part, whole = F.col(self.part), F.col(self.whole)
        held = [part >= self.low * whole] if self.low is not None else []
        held += [part <= self.high * whole] if self.high is not None else []
        return reduce(lambda a, b: a & b, held, F.lit(True))


#: A document fails the base if it breaks one of these.
BASE = (Rule("words", "n_words", "one", low=50), Rule("repeated_words", "n_repeat_words", "n_words", high=0.5))
#: The thresholds of the verdict, besides the base.
RULES = (
    Rule("most_words", "n_words", "one", high=100_000),
    Rule("word_length", "word_chars", "n_words", low=3, high=10),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.06),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3),
)


def _stop_words() -> list[str]:
    words = sorted(set(STOP_WORDS.split()))
    return [*words, *(w[0].upper() + w[1:] for w in words)]


def repeated_words(words: str) -> tuple[list[tuple[str, Column]], Column]:
    """Columns to add one after the other, and the count of words in 3-word windows found twice or more.

    A window is known by a 64-bit hash of its three words. Only texts in which a
    hash repeats sort their windows.
    """
    w, n = F.col(words), F.size(words)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    ordered = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda e, k: (e["h"] == F.get(F.col("_ordered"), k + 1)["h"]) | (e["h"] == F.get(F.col("_ordered"), k - 1)["h"])
    places = F.flatten(F.transform(F.filter("_ordered", same), lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
    return [("_hashes", hashes), ("_ordered", ordered)], F.coalesce(F.size(F.array_distinct(places)), F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the counts that rules name."""
    steps, repeated = repeated_words("_words")
    docs = docs.withColumn("_words", words_of(text_of())).withColumn("_lines", F.filter(F.split(text_of(), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    for name, column in steps:
        docs = docs.withColumn(name, column)
    counts = {
        "one": F.lit(1),
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.length(text_of()) - F.length(F.translate(text_of(), "#*$%&|<>", "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated,
        "n_stop_words": F.size(F.filter("_words", lambda x: x.isin(_stop_words()))),
        "n_bullet_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
    }
    # inline() keeps a later filter on a count above this step; pushed below, it would compute the counts twice.
    kept = [c for c in docs.columns if c not in (*counts, "_words", "_lines", "_hashes", "_ordered")]
    return docs.select(*kept, F.inline(F.array(F.struct(*(v.cast("long").alias(k) for k, v in counts.items())))))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the counts, base_failed and kept.

    Null and empty texts have no words and fail the base. Repeated rows are
    judged alike; ties don't occur. Very long texts are judged whole. The columns
    that are added replace columns of docs of the same name, others stay. No rows: no rows.
    """
    measures = measured(docs)
    base_failed = ~reduce(lambda a, b: a & b, (r.passes() for r in BASE))
    return measures.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & reduce(lambda a, b: a & b, (r.passes() for r in rules), F.lit(True)))
