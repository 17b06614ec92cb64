"""Near-duplicates by the Jaccard similarity of word shingles, without loss.

SimHash proposes first: fingerprints within DISTANCE bits are linked by the
generalised pigeonhole of ``simhash``, and each of a component is compared with
the component's least. Fingerprints of texts that share 0.8 of their shingles lie
about ten bits apart, which no pigeonhole can select, so an exact way finds the rest:
two sets of similarity 0.8 or more share a member among the first n - ceil(0.8 n) + 1
of each, in any order that holds for all sets. Here shingles of an even hash come
first, those that fewest texts have before others, the rest by hash; among the texts
that this leaves, all shingles are ordered by how few have them. A shingle that
no other text has can't be shared, so a text whose prefix is made of such ones is
done, and passages that many texts share are at no prefix unless little else is.
The prefixes meet by an equi-join, candidates are bounded by their places, then by
what their prefixes share, and verified on the whole sets.

Large groups make no squares: members are first compared with pivots of their
prefix shingle (the text of the most common shingles, and the least and the greatest
hash), and then only with members of other components that share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, by_batches, parts_of, text_of
from .components import components

WIDTH = 5
#: Bits between fingerprints that SimHash links.
DISTANCE = 3
#: Candidates of a node that are verified in one task.
_PAIRS = 64


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, a blank one has none."""
    return np.unique(simhash.shingle_hashes(text, WIDTH).view(np.int64))


def prefix_length(n: int) -> int:
    return n + (-4 * n // 5) + 1 if n else 0


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of().alias("text")).withColumn("key", F.xxhash64("text"))


def told(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), node (a hash of its set), fp (its fingerprint), n, even and odd for every row.

    even has all shingles of an even hash; odd, of the others, the first ones that
    the prefix needs if the even ones don't fill it.
    """

    def row(text: str) -> tuple[int, int, int, np.ndarray, np.ndarray]:
        hashes = simhash.shingle_hashes(text, WIDTH)
        found = np.unique(hashes.view(np.int64))
        is_odd = (found & 1).astype(bool)
        even = found[~is_odd]
        odd = found[is_odd][: max(0, prefix_length(len(found)) - len(even))]
        return xxhash.xxh3_64_intdigest(found.tobytes()), simhash.fingerprint(hashes), len(found), even, odd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        longs = lambda x: np.array(x, np.uint64).view(np.int64)
        for batch in batches:
            for part in parts_of(batch, "text"):
                node, fp, n, even, odd = zip(*map(row, part["text"]), strict=True)
                yield pd.DataFrame({"doc_id": part["doc_id"], "key": part["key"], "node": longs(node), "fp": longs(fp), "n": np.array(n, np.int32), "even": list(even), "odd": list(odd)})

    return by_batches(_keyed(docs), run, "key long, node long, fp long, n int, even array<long>, odd array<long>")


def _prefix(n: Column) -> Column:
    """prefix_length as a column."""
    return F.when(n > 0, n - F.ceil(n * 4 / 5) + 1).otherwise(0).cast("int")


def prefixes(raw: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """node, n, h, pos, rare: the prefix members that several nodes have, with their places in the order.

    sizes has node, n and n_even, the number of even shingles; rare is the number
    of those that no other node has.
    """
    even = raw.select("node", F.explode("even").alias("h"), F.lit(-1).alias("pos"))
    odd = raw.select("node", F.size("even").alias("n_even"), F.posexplode("odd").alias("pos", "h")).select("node", "h", F.col("pos") + F.col("n_even"))
    # One shuffle serves both steps: copies of a node are one, and nodes are counted by shingle.
    met = even.union(odd).repartition("h").groupBy("h", "node", "pos").agg(F.lit(1).alias("_one")).drop("_one")
    held = scratch.write(met.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h")).cast("int")).filter("df > 1"))
    out = _placed(held, sizes, scratch)
    scratch.drop(held)
    return out


def _placed(held: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """node, n, h, pos, rare of the prefix members among held (h, node, pos, df), where a pos of -1 is to be found."""
    # A node's rare shingles fill the first places; if they fill the prefix, nothing of it is shared.
    rare = F.col("n_even") - F.count(F.when(F.col("pos") < 0, 1)).over(Window.partitionBy("node"))
    near = held.join(sizes.hint("merge"), "node").withColumn("rare", rare.cast("int")).filter(F.col("rare") < _prefix(F.col("n")))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("pos") >= 0, "df", "h"))
    placed = near.withColumn("_k", place).withColumn("pos", F.when(F.col("pos") < 0, F.col("rare") + F.col("_k") - 1).otherwise(F.col("pos")))
    return scratch.write(placed.filter(F.col("pos") < _prefix(F.col("n"))).select("node", "n", "h", "pos", "rare"))


def narrowed(whole: DataFrame, scratch: Scratch) -> DataFrame:
    """The prefixes of whole sets (node, members, n) in the order of how few of these sets have a shingle, whatever its hash."""
    met = whole.select("node", F.explode("members").alias("h"), F.lit(-1).alias("pos"))
    held = met.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h")).cast("int")).filter("df > 1")
    return _placed(held, whole.select("node", "n", F.col("n").alias("n_even")), scratch)


def _whole(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """node, members, n of the asked nodes (node, first), from one of their texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in parts_of(batch, "text"):
                members = [shingles(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "members": members, "n": [len(m) for m in members]})

    keys = asked.select("node", F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key"))
    # As at any size: Spark would broadcast a small table.
    texts = _keyed(docs).join(keys.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    texts = texts.groupBy(F.col("node").alias("doc_id")).agg(F.any_value("text").alias("text"))  # repeated rows
    return by_batches(texts, run, "members array<long>, n int").withColumnRenamed("doc_id", "node")


def _may_reach(n: Column, pos: Column, other_n: Column, other_pos: Column) -> Column:
    """Whether two sets whose first common shingle has these places can be similar enough."""
    return 9 * F.least(n - pos, other_n - other_pos) >= 4 * (n + other_n)


def _asked(pairs: DataFrame) -> DataFrame:
    """node and parts, by which its array is spread, for all nodes of pairs (a, b, parts)."""
    ends = pairs.select(F.col("a").alias("node"), "parts").unionByName(pairs.select(F.col("b").alias("node"), F.lit(1).cast("long").alias("parts")))
    return ends.groupBy("node").agg(F.max("parts").alias("parts"))


def _attached(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with both sets (node, members, n), where a node of many pairs meets them in as many tasks as it has parts."""
    many = pairs.groupBy("a").agg(F.max("parts").alias("parts"))
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("_a"), F.col("n").alias("_na")).join(many, "a")
    left = left.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "_a", "_na")
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("_b"), F.col("n").alias("_nb"))
    return pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).join(left, ["a", "part"]).join(right, "b")


def _likely(shared: Column) -> Column:
    """Whether sets of _na and _nb members that share so many of their prefixes can be similar enough.

    Of two sets, what is common and not in both prefixes lies behind the prefix that ends first in the order.
    """
    beyond = F.greatest(F.col("_na") - _prefix(F.col("_na")), F.col("_nb") - _prefix(F.col("_nb")))
    return 9 * (shared + beyond) >= 4 * (F.col("_na") + F.col("_nb"))


def _similar(pairs: DataFrame, sets: DataFrame, whole: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs a, b of similarity 0.8 or more, out of a, b, parts: first by their prefixes (sets), then by the whole sets."""
    proposed = scratch.write(pairs.groupBy("a", "b").agg(F.max("parts").alias("parts")))
    shared = F.size(F.array_intersect("_a", "_b"))
    # Both ends share a prefix member with some text, or they aren't similar to any.
    asked = scratch.write(_attached(proposed, sets).filter(_likely(shared)).select("a", "b", "parts"))
    found = scratch.write(_attached(asked, whole).filter(9 * shared >= 4 * (F.col("_na") + F.col("_nb"))).select("a", "b"))
    scratch.drop(proposed, asked)
    return found


def _ordered(rows: DataFrame, x: str, y: str, *more: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (F.floor(F.col("count") / _PAIRS) + 1).cast("long").alias("parts"), *more)


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """a, b, parts: each node and the least of those that links of fingerprints within DISTANCE bits lead to."""
    roots = components(simhash.linked(nodes.select("fp").distinct(), DISTANCE)).withColumnRenamed("node", "fp")
    placed = nodes.select("node", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    hubs = placed.groupBy("root").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("count")).filter("count > 1")
    return _ordered(placed.join(hubs, "root").filter("node <> hub"), "node", "hub")


def near_pairs(nodes: DataFrame, index: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs a < b of similar nodes that join all nodes which similar pairs join; pairs within a component may be left out.

    nodes has node, first, fp; index is what prefixes gives.
    """
    by_h = Window.partitionBy("h")
    met = index.withColumn("count", F.count(F.lit(1)).over(by_h)).filter("count > 1").select("node").distinct()
    whole = scratch.write(_whole(nodes.join(met, "node", "left_semi").select("node", "first"), docs))
    # Few texts are left; among them all shingles can be counted, which leaves fewer.
    index = narrowed(whole, scratch)
    me = F.struct("node", "n", "pos")
    plain = F.struct((F.col("rare") / F.col("n")).alias("share"), "node", "n", "pos")
    held = index.withColumn("count", F.count(F.lit(1)).over(by_h)).filter("count > 1")
    pivot = F.array_distinct(F.array(F.struct(*(F.min(plain).over(by_h)[c].alias(c) for c in ("node", "n", "pos"))), F.min(me).over(by_h), F.max(me).over(by_h)))
    held = scratch.write(held.withColumn("pivots", pivot))
    scratch.drop(index)
    sets = scratch.write(held.groupBy("node").agg(F.collect_list("h").alias("members"), F.max("n").alias("n")))
    pivots = held.withColumn("pivot", F.explode("pivots")).filter(F.col("node") != F.col("pivot.node"))
    pivots = pivots.filter(_may_reach(F.col("n"), F.col("pos"), F.col("pivot.n"), F.col("pivot.pos")))
    pivots = _ordered(pivots.select("node", F.col("pivot.node").alias("other"), "count"), "node", "other").unionByName(_by_fingerprint(nodes))
    edges = _similar(pivots, sets, whole, scratch)
    # shingles that several components share
    live = held.select("h", "node", "n", "pos", "count").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    live = scratch.write(live.withColumn("_low", F.min("root").over(by_h)).withColumn("_high", F.max("root").over(by_h)).filter("_low < _high").drop("_low", "_high"))
    scratch.drop(held)
    x = live.select("h", F.col("root").alias("root_a"), F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"), "count")
    y = live.select("h", F.col("root").alias("root_b"), F.col("node").alias("y"), F.col("n").alias("y_n"), F.col("pos").alias("y_pos"))
    rest = x.join(y, "h").filter("root_a < root_b").filter(_may_reach(F.col("x_n"), F.col("x_pos"), F.col("y_n"), F.col("y_pos")))
    more = _similar(_ordered(rest, "x", "y"), sets, whole, scratch)
    scratch.drop(live, sets, whole)
    return edges.unionByName(more)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, key, component_id, first for every row of docs (doc_id, text).

    component_id is the least doc_id that links of similarity 0.8 or more lead to,
    null if none of the component has one. key is a hash of the text, and first
    the doc_id and key of the row that stands for the component: that of the least
    doc_id, null ones last, and of those of several texts the one of the least key.
    So equal doc_ids on different texts stay apart.

    Texts of equal sets are one node; null and blank texts have the empty set and
    are copies of each other. A text of fewer than WIDTH words is one shingle. Very
    long texts are one array of eight bytes a word in a task. Repeated rows are
    kept. No rows: no rows. Other columns of docs are ignored.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select("doc_id", "text")
    raw = scratch.write(told(docs))
    rows = scratch.write(raw.select("doc_id", "key", "node", "fp", "n", F.size("even").alias("n_even")))
    me = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    nodes = scratch.write(rows.groupBy("node").agg(F.min(me).alias("first"), F.min("fp").alias("fp"), F.max("n").alias("n"), F.max("n_even").alias("n_even")))
    index = prefixes(raw, nodes.select("node", "n", "n_even"), scratch)
    scratch.drop(raw)
    roots = components(near_pairs(nodes, index, docs, scratch))
    members = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = members.groupBy("root").agg(F.min("first").alias("first"))
    placed = scratch.write(members.select("node", "root").join(least, "root").select("node", "first"))
    scratch.drop(nodes)
    return rows.join(placed, "node").select("doc_id", "key", F.col("first.doc_id").alias("component_id"), F.struct("first.doc_id", "first.key").alias("first"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that another stands for: one row stays of each group of near copies.

    All columns stay. Rows to drop are told by doc_id and a hash of the text; of
    repeated rows one stays. The rows to drop, not the kept ones, meet the texts.
    """
    scratch = Scratch(docs.sparkSession, "first-of-each")
    found = near_copies(docs)
    mine = F.struct("doc_id", "key")
    seen = found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("_n"), F.any_value(~mine.eqNullSafe(F.col("first"))).alias("_drop")).filter("_drop OR _n > 1")
    seen = scratch.write(seen.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_drop"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text_of()) == F.col("_key"))
    # As at any size: Spark would broadcast a small table.
    marked = docs.join(seen.hint("merge"), same, "left").filter("NOT coalesce(_drop, false)")
    once = marked.filter("_drop IS NOT NULL").dropDuplicates(["_id", "_key"])  # repeated rows
    return marked.filter("_drop IS NULL").unionByName(once).drop("_id", "_key", "_drop")
