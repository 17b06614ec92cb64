"""A text is split, and its placeholders are replaced, once for each row."""

import re

import pytest
from pyspark.sql import functions as F

from loreweave.functions import text as T


def _times(spark, column, word):
    plan = spark.createDataFrame([("a",)], "t string").select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(word, plan))


def test_one_split_for_citations(spark):
    assert _times(spark, T.align_citations(F.col("t"), F.lit(3)), r"\bsplit\(") == 1
    assert T.MARKERS == "".join(map(chr, range(ord(T.MARKERS[0]), ord(T.MARKERS[-1]) + 1)))


def test_one_pass_for_each_placeholder(spark):
    assert _times(spark, T.sanitise(F.col("t")), r"\bregexp_replace\(") == len(T.PLACEHOLDERS) + 1


@pytest.mark.parametrize("held, placed", zip(T.HELD_BY, ("[object  X]", "<undefined>", "<null>", "<empty>", "{{a.b}}", "${x-y}", "undefined", "null", "NaN"), strict=True))
def test_each_placeholder_holds_what_is_looked_for(spark, held, placed):
    assert held in placed
    row = spark.createDataFrame([(f"a {placed} b", placed, placed * 2, None)], "a string, b string, c string, d string").select(*(T.sanitise(F.col(c)) for c in "abcd")).first()
    twice = placed * 2 if placed[0] not in "[<{$" else None  # two words run together are another word
    assert tuple(row) == (f"a {T.ODD} b", T.USELESS, twice or T.USELESS, None)
