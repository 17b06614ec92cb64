"""Prefix tree of conversations, rolled up by pointer jumping.

A node is a distinct sequence of a conversation's first d turns. Each turn draws
four 32-bit numbers by SHA-256 from its place, role and text. A prefix is keyed
by the digest of its length and the sums of its turns' numbers: running sums, so
a conversation of any length is summed in slices. The key of the prefix that is
a turn shorter is its parent's, which makes the edge to the parent.

Subtrees are summed in doubling rounds. Before round k a node holds the sum over
its descendants nearer than 2**k, itself included, and points to its ancestor at
2**k. In the round it adds what the nodes that point to it hold, and its pointer
jumps to where its ancestor points. So the rounds grow with the logarithm of the
depth, and a round has the nodes of at least that depth. What nodes hold is added up by a groupBy, with sums in the tasks first.
A jump joins on a key that many nodes may share: targets that more than a
thousandth of all pointers name are at most a thousand, and are broadcast; the
others meet in a join of which no key has more rows than that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, gapless_rank

#: A target is broadcast if more than one in SHARE pointers names it.
SHARE = 1000
#: Turns of a conversation that are ordered and summed in one task, by their number.
SLICE = 1024
#: Adjacent conv_ids, 2 to this power, whose digits are joined in one value.
IDS = 12
SUMS = ("k0", "k1", "k2", "k3")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place from 0, role, text in the order of turn, role and text; a null turn comes first."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    turns = turns.filter("conv_id IS NOT NULL").withColumn("_slice", F.expr(f"coalesce(floor(turn / {SLICE}), -9223372036854775808L)"))
    return gapless_rank(turns, ["conv_id"], "_slice", ["turn", "role", "text"], "place").select("conv_id", "_slice", "place", "role", "text")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, depth from 1, role, text) and the lengths (conv_id, length) of all conversations, of those without turns too.

    A conversation takes its first h turns from the first of its five, h from its
    number's checksum; its own turns follow from the one at h.
    """
    slices = turns.groupBy("conv_id", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    own = slices.groupBy("conv_id").agg(F.sum("_n").alias("own"))
    convs = own.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h"))
    given = convs.join(own.select(F.col("conv_id").alias("base"), F.col("own").alias("_n")), "base", "left").withColumn("given", F.least("h", F.coalesce("_n", F.lit(0)))).drop("_n")
    heads = turns.filter("place < 8").select(F.col("conv_id").alias("base"), "place", "role", "text")
    taken = given.select("conv_id", "base", "given").join(heads, "base").filter("place < given").select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text")
    by_slice = slices.join(given, "conv_id").select("conv_id", "_slice", "h", "given")
    rest = turns.join(by_slice, ["conv_id", "_slice"]).filter("place >= h").select("conv_id", (F.col("given") + F.col("place") - F.col("h") + 1).alias("depth"), "role", "text")
    return taken.unionByName(rest), given.select("conv_id", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def key_of(depth: Column, sums: list[Column]) -> Column:
    """128 bits of a digest of a prefix's length and sums."""
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", depth.cast("string"), *(s.cast("string") for s in sums)), 256), 1, 32))


def keyed(turns: DataFrame) -> DataFrame:
    """conv_id, depth, size (bytes of the last text), key and parent of every prefix of the rebuilt turns.

    Slices of a conversation are summed apart and shifted by the sums of those before.
    """
    digest = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), F.octet_length("role").cast("string"), "role", "text"), 256)
    drawn = turns.select("conv_id", "depth", F.octet_length("text").cast("long").alias("size"), F.expr(f"(depth - 1) DIV {SLICE}").alias("_slice"), digest.alias("_digest"))
    drawn = drawn.select("conv_id", "depth", "size", "_slice", *(F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(k) for i, k in enumerate(SUMS)))
    before = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = drawn.groupBy("conv_id", "_slice").agg(*(F.sum(k).alias(k) for k in SUMS))
    starts = slices.select("conv_id", "_slice", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in SUMS))
    up_to = Window.partitionBy("conv_id", "_slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = drawn.select("*", *(F.sum(k).over(up_to).alias(f"_up_{k}") for k in SUMS)).join(starts, ["conv_id", "_slice"])
    at = {k: F.col(f"_{k}") + F.col(f"_up_{k}") for k in SUMS}
    return summed.select("conv_id", "depth", "size", key_of(F.col("depth"), list(at.values())).alias("key"), key_of(F.col("depth") - 1, [v - F.col(k) for k, v in at.items()]).alias("parent"))


def root_key() -> Column:
    return key_of(F.lit(0), [F.lit(0)] * len(SUMS))


def looked_up(rows: DataFrame, on: str, targets: DataFrame, named: DataFrame) -> DataFrame:
    """rows with the columns of their target in targets, which is unique by ``on``; a row without one goes.

    named: on and _n, the rows that name a target. Targets that more than one in
    SHARE rows names, SHARE at most, are broadcast to those rows.
    """
    total = named.agg(F.sum("_n")).first()[0] or 0
    hot = named.filter(F.col("_n") * SHARE > total).select(on)
    found = targets.join(F.broadcast(hot), on).withColumn("_hot", F.lit(True))
    tried = rows.join(F.broadcast(found), on, "left")
    added = [c for c in targets.columns if c != on]
    return tried.filter("_hot").drop("_hot").unionByName(tried.filter("_hot IS NULL").drop("_hot", *added).join(targets, on))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the pieces of each key, joined by commas; the pieces come sorted and pass one by one."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch["key"], batch["ids"], strict=True):
            if k == key:
                digest.update(b"," + ids.encode())
            else:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if digest:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of the conv_ids that end at a node, ascending.

    A digest of a list can't be put together from parts; so the ids are joined to
    pieces first, each of adjacent numbers, and the task of a node that many end at
    takes the pieces one by one.
    """
    pieces = ends.groupBy("key", F.shiftright("conv_id", IDS).alias("_piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return pieces.repartition("key").sortWithinPartitions("key", "_piece").select("key", "ids").mapInPandas(_hashed, "key binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, values: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """nodes (key, depth, parent and values), each value summed over the node's subtree.

    A round takes the nodes that have an ancestor at its distance, so few deep
    conversations cost little. What it adds to ancestors is written, and added up
    with all rounds' at the end.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    added, reach = [nodes.select("key", *values)], 1
    active = nodes.filter("depth > 0").select("key", "depth", F.col("parent").alias("_at"), *values)
    while reach <= deepest:
        held = scratch.write(active.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(v).alias(v) for v in values)))
        added.append(held.select(F.col("_at").alias("key"), *values))
        more = added[-1].select("key", *(F.col(v).alias(f"_{v}") for v in values))
        left = active.filter(F.col("depth") >= 2 * reach).join(more, "key", "left").select("key", "depth", "_at", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values))
        # The node at twice the reach points to the root; those below ask their ancestor.
        up = looked_up(left.filter(F.col("depth") > 2 * reach), "_at", active.select(F.col("key").alias("_at"), F.col("_at").alias("_next")), held.select("_at", "_n"))
        top = left.filter(F.col("depth") == 2 * reach).withColumn("_at", root_key())
        after = scratch.write(top.unionByName(up.drop("_at").withColumnRenamed("_next", "_at")))
        if reach > 1:
            scratch.drop(active)
        active, reach = after, 2 * reach
    sums = reduce(DataFrame.unionByName, added).groupBy("key").agg(*(F.sum(v).alias(v) for v in values))
    return nodes.drop(*values).join(sums, "key")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Conversations are rebuilt first (see rebuilt). conv_id is a node's smallest
    member, saved_tokens the bytes of last texts that its subtree needs only once.

    A null role or text is empty, a null turn comes before all others, and equal
    turn numbers are ordered by role and text; repeated rows are turns of their
    own. A row without conv_id belongs to no conversation. Very long texts are
    digested whole. No conversations: no root, no rows. Other columns are ignored. Turns
    of a conversation that have one number are ordered in one task.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.write(ordered_turns(conversations))
    prefixes, lengths = rebuilt(turns)
    lengths, paths = scratch.write(lengths), scratch.write(keyed(prefixes))
    scratch.drop(turns)

    nodes = paths.groupBy("key").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("_size"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    nodes = nodes.unionByName(root.select(root_key().alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("_size")))
    nodes = scratch.write(nodes)
    children = scratch.write(nodes.filter("depth > 0").groupBy("parent").agg(F.count(F.lit(1)).alias("_n")))
    leaves, saved = F.when(F.col("_n").isNull(), 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("_size")
    states = scratch.write(nodes.join(children.withColumnRenamed("parent", "key"), "key", "left").select("key", "depth", "parent", "conv_id", "n_convs", F.coalesce("_n", F.lit(0)).cast("long").alias("n_children"), leaves.alias("n_leaves"), saved.alias("saved_tokens")))
    sums = rolled_up(states, ("n_leaves", "saved_tokens"), scratch)

    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = looked_up(sums.filter("depth > 0"), "parent", parents, children)
    placed = below.unionByName(sums.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    last = lengths.withColumnRenamed("length", "depth")
    ends = paths.join(last, ["conv_id", "depth"]).select("key", "conv_id").unionByName(last.filter("depth = 0").select(root_key().alias("key"), "conv_id"))
    found = placed.join(ends_digests(ends), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
