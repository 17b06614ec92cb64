"""How far the sources of a language diverge in their terms.

Each language keeps the terms of at least LEAST_DOCUMENTS of its documents. A
count c of a group with N kept occurrences has the probability, in billionths,
p(c) = 1 + floor(10**9 * (c + 5) / (N + 5 * V)), where V terms are kept.

The divergence of two sources is the sum of abs(p - q) over all V terms. A term
that neither has adds f0 = abs(p(0) - q(0)), so every pair starts at V * f0, and
the postings of an inverted index emit corrections to that, and only those that
are not zero:

* a posting against a source as if that had not the term: abs(p(c) - q(0)) - f0.
  It depends on the posting's count alone, so the postings of a source are
  summed up by count first and no pair of a term and a source is made.
* a term that both have: what both postings have emitted too much or too little,
  abs(p - q) - abs(p - q(0)) - abs(p(0) - q) + f0.

Counts are summed exactly in decimals and longs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of

LEAST_DOCUMENTS = 30
#: Added to every count.
PRIOR = 5
TOP_TERMS = 50
#: Bits of the filter of terms; it holds 8 MB at most, whatever the corpus.
FILTER_BITS = 1 << 26
#: Rows that a task sums up before it hands them on, and bytes of text taken at once.
HELD, PART = 1 << 20, 1 << 22
#: Terms are runs of letters of ASCII and of all characters beyond.
_IN_TERM = np.array([chr(b).isalpha() or b >= 0x80 for b in range(256)])
_WEIGHTS = np.random.default_rng(11).integers(1 << 63, size=4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def terms_in(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """All terms of some texts (large_binary) in order, and for each the index of its text."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(inside)[at] - 1, np.count_nonzero(inside)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
    return np.searchsorted(bounds, at, "right") - 1, words.dictionary_encode()


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    found, at = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(at, v, len(found)).astype(np.int64) for v in values)


def tallies(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[pa.Table, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Part by part of a batch: the groups by keys, the terms, and for each group and term that meet: both indices, occurrences and documents."""
    texts = batch.column("text").cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset))
    part = (np.cumsum(sizes) - sizes) // PART
    edges = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), len(texts)] if len(texts) else [0]
    for first, after in zip(edges[:-1], edges[1:], strict=True):
        rows = pa.table({k: batch.column(k)[first:after] for k in keys} | {"row": np.arange(after - first)})
        groups = rows.group_by(keys, use_threads=False).aggregate([("row", "list")])
        members = groups.column("row_list").combine_chunks()
        of = np.empty(after - first, np.int64)
        of[members.flatten().to_numpy()] = np.repeat(np.arange(len(groups)), members.value_lengths().to_numpy())
        doc, words = terms_in(texts[first:after])
        size = max(1, len(words.dictionary))
        by_doc, n = np.unique(doc * size + words.indices.to_numpy(), return_counts=True)
        by_group, n, docs = _summed(of[by_doc // size] * size + by_doc % size, n, np.ones(len(n)))
        yield groups.select(keys), words.dictionary, by_group // size, by_group % size, n, docs


def buckets(lang: str, terms: pa.Array) -> np.ndarray:
    """The place of each term in the filter: its bytes, weighted by position, mixed with the language."""
    terms = terms.cast(pa.large_binary())
    if not len(terms):
        return np.empty(0, np.int64)
    bounds = np.frombuffer(terms.buffers()[1], np.int64, len(terms) + 1, 8 * terms.offset)
    data = np.frombuffer(terms.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    begins = bounds[:-1] - bounds[0]
    place = np.arange(len(data)) - np.repeat(begins, np.diff(bounds))
    mixed = np.add.reduceat((data + np.uint64(1)) * _WEIGHTS[place % len(_WEIGHTS)], begins) + np.uint64(zlib.crc32(lang.encode()))
    return ((mixed ^ mixed >> np.uint64(29)) * _WEIGHTS[0] >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by bucket, summed up in the task."""
    bucket, docs = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        for groups, terms, group, term, _, n in tallies(batch, ["lang"]):
            for k, lang in enumerate(groups.column("lang").to_pylist()):
                own = group == k
                bucket, docs = np.r_[bucket, buckets(lang, terms.take(term[own]))], np.r_[docs, n[own]]
            if len(bucket) > HELD:
                bucket, docs = _summed(bucket, docs)
                if len(bucket) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([bucket, docs], ["bucket", "docs"])
                    bucket, docs = bucket[:0], docs[:0]
    bucket, docs = _summed(bucket, docs)
    yield pa.RecordBatch.from_arrays([bucket, docs], ["bucket", "docs"])


def _counts(kept: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences and documents by group and term of the filter, summed up in the task; each group also with a null term."""
    names = ["lang", "source", "term"]

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(names, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*names, "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for batch in batches:
            for groups, terms, group, term, n, docs in tallies(batch, ["lang", "source"]):
                langs, passes = groups.column("lang").to_pylist(), np.zeros(len(group), bool)
                for lang in set(langs):
                    own = np.isin(group, [k for k, v in enumerate(langs) if v == lang])
                    used = np.unique(term[own])
                    at = buckets(lang, terms.take(used))
                    holds = np.zeros(len(terms), bool)
                    holds[used] = kept[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
                    passes[own] = holds[term[own]]
                found = groups.take(group[passes]).append_column("term", terms.take(term[passes]).cast(pa.string())).append_column("n", pa.array(n[passes])).append_column("docs", pa.array(docs[passes]))
                none = np.zeros(len(groups), np.int64)
                parts += [found, groups.append_column("term", pa.nulls(len(groups), pa.string())).append_column("n", pa.array(none)).append_column("docs", pa.array(none))]
            if sum(map(len, parts)) > HELD:
                parts = [summed(parts)]
                if len(parts[0]) > HELD // 2:
                    yield from parts[0].to_batches()
                    parts = []
        if parts:
            yield from summed(parts).to_batches()

    return run


def term_filter(docs: DataFrame, least: int) -> np.ndarray:
    """A bitmap that holds every term of at least ``least`` documents of a language, and few others.

    Terms are counted by their bucket, so a bucket has at least its term's
    documents. The driver gets the words of the bitmap that aren't zero, FILTER_BITS / 64 at most.
    """
    counted = docs.mapInArrow(_frequencies, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    words = counted.groupBy(F.expr("bucket >> 6").alias("word")).agg(F.expr("bit_or(1L << cast(bucket & 63 AS INT))").alias("bits")).toArrow()
    kept = np.zeros(FILTER_BITS // 64, np.int64)
    kept[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return kept.view(np.uint64)


def kept_postings(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n, lang_n (the term's occurrences in the language) of kept terms; a null term for every group.

    Most terms are rare, so a first pass makes a filter that lets few of them into
    the second one. Tasks sum up their documents before the one shuffle of
    postings, by language and term; all sums after it need no other.
    """
    texts = docs.select(*(text_of(c).alias(c) for c in ("lang", "source", "text")))
    parts = texts.mapInArrow(_counts(term_filter(texts, least)), "lang string, source string, term string, n long, docs long")
    postings = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    summed = postings.withColumn("lang_n", F.sum("n").over(term)).withColumn("_docs", F.sum("docs").over(term))
    return summed.filter(F.col("term").isNull() | (F.col("_docs") >= least)).select("lang", "source", "term", "n", "lang_n")


def probability(count: str, total: str = "total", terms: str = "n_kept") -> Column:
    """In billionths, of columns or values by name; null where no term is kept. Decimals hold what a long can't."""
    return F.expr(f"1 + (CAST({count} + {PRIOR} AS DECIMAL(28, 0)) * 1000000000BD) DIV CAST(nullif({total} + {PRIOR} * {terms}, 0) AS DECIMAL(28, 0))")


def _both(one: DataFrame) -> DataFrame:
    """lang, a, b, value, also with a and b exchanged."""
    return one.select("lang", "a", "b", "value").unionByName(one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))


def _corrections(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value: nonzero corrections to the baseline of each pair of sources, for both orders of a pair."""
    one = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("a_zero"), F.col("total").alias("a_total"), "n_kept")
    other = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("b_zero"))
    alone = postings.groupBy("lang", F.col("source").alias("a"), "n").agg(F.count(F.lit(1)).alias("terms")).join(one, ["lang", "a"]).withColumn("a_p", probability("n", "a_total"))
    alone = alone.join(other, "lang").filter("a <> b").withColumn("value", F.expr("terms * (abs(a_p - b_zero) - abs(a_zero - b_zero))"))

    placed = postings.join(groups, ["lang", "source"]).select("lang", "term", "source", "zero", probability("n").alias("p"))
    a = placed.toDF("lang", "term", "a", "a_zero", "a_p")
    b = placed.toDF("lang", "term", "b", "b_zero", "b_p")
    shared = a.join(b, ["lang", "term"]).filter("a < b").withColumn("value", F.expr("abs(a_p - b_p) - abs(a_p - b_zero) - abs(a_zero - b_p) + abs(a_zero - b_zero)"))
    found = _both(alone).unionByName(_both(shared)).filter("value <> 0")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, p, q, value, rank for every group of a language and a source.

    Part pair: item is another source of the language, value their divergence; p
    and q are null. Part term: item is a kept term that is likelier in the group
    (p) than in the language (q), value their distance, the ``top`` largest ones.
    Ranks go by value, largest first, and then by the item's UTF-8 bytes.

    Null lang, source and text are empty strings. Empty texts have no terms, yet
    their groups occur; a language without kept terms has pairs of value 0, and a
    single source no pair. Repeated rows each count as a document. Very long texts are
    read whole, a batch at a time. No rows: no rows. Other columns are ignored. The
    result has a row for each ordered pair of sources, so it grows with their square.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    rows = scratch.write(kept_postings(docs, least))
    postings = rows.filter("term IS NOT NULL")
    by_term = postings.select("lang", "term", "lang_n").distinct()
    langs = by_term.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("lang_n").alias("lang_total"))
    groups = rows.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang", "left").fillna(0, ["n_kept", "lang_total"])
    groups = scratch.write(groups.withColumn("zero", probability("0L")))

    terms = postings.join(groups, ["lang", "source"]).withColumn("p", probability("n")).withColumn("q", probability("lang_n", "lang_total")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "p", "q", (F.col("p") - F.col("q")).alias("value"))

    one, other = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("a_zero"), "n_kept"), groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("b_zero"))
    pairs = one.join(other, "lang").filter("a <> b").join(_corrections(postings, groups).withColumnRenamed("value", "_more"), ["lang", "a", "b"], "left")
    value = F.expr("coalesce(n_kept * abs(a_zero - b_zero), 0) + coalesce(_more, 0)")
    none = F.lit(None).cast("long")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), none.alias("p"), none.alias("q"), value.alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [r.withColumn("rank", F.row_number().over(order)) for r in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
