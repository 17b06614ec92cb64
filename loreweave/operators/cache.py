"""Replay of a query cache: least-recently-used eviction and a time to live, exactly and in parallel.

Every request puts its key at the head of the cache, a hit as well as a miss, so
the cache holds the ``most`` keys asked for last. A request finds its key there if
fewer than ``most`` other keys were asked for since (its reuse distance). Time is
cut into slices of about equal requests. What a slice leaves in the cache are its
last keys; merged over the slices before, in doubling steps, they are what a slice
starts with, and behind them it counts its distances alone.

An entry's time starts with the miss that stored it and isn't renewed by hits. So
every request points to the first later one that would find it too old; misses are
the requests that such pointers reach from those that didn't find their key. They
are marked by doubling the pointers. A key of many requests is spread over slices
in the first step, and over windows of the time to live in the second.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.sources.checkpoints import written_once

SECONDS, MOST = 300, 100
ROWS_PER_SLICE = 100_000


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value the number of smaller ones before it, by merging sorted halves."""
    n, found = len(values), np.zeros(len(values), np.int64)
    place, wide = np.arange(n), np.int64(values.max(initial=0) - values.min(initial=0) + 2)
    shifted, half = values - values.min(initial=0), 1
    while half < n:
        pair, right = place // (2 * half), place // half % 2 == 1
        left = np.sort(pair[~right] * wide + shifted[~right])
        found[right] += np.searchsorted(left, pair[right] * wide + shifted[right]) - np.searchsorted(left, pair[right] * wide)
        half *= 2
    return found


def absent(keys: np.ndarray, held: np.ndarray, most: int) -> np.ndarray:
    """Which of a slice's requests don't find their key; held: the keys that it starts with, the oldest first."""
    codes = pd.factorize(np.concatenate((held, keys)))[0]
    order = np.argsort(codes, kind="stable")
    before = np.full(len(codes), -1, np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    distance = smaller_before(before) - (before + 1)
    return ((before < 0) | (distance >= most))[len(held) :]


def _latest(stacks: DataFrame, most: int) -> DataFrame:
    newest = stacks.groupBy("_slice", "_key").agg(F.max("_last").alias("_last"))
    return newest.withColumn("_n", F.row_number().over(Window.partitionBy("_slice").orderBy(F.desc("_last")))).filter(F.col("_n") <= most).drop("_n")


def _evicted(rows: DataFrame, most: int, rows_per_slice: int) -> DataFrame:
    """rows (_key, _at, id, _row) with _new: the key isn't among the ``most`` asked for last."""
    slices = max(1, -(-rows.count() // rows_per_slice))
    placed = written_once(rows.repartitionByRange(slices, "_at", "id", "_row").withColumn("_slice", F.spark_partition_id()))
    stacks, reach = _latest(placed.select("_slice", "_key", F.struct("_at", "id", "_row").alias("_last")), most), 1
    while reach < slices - 1:
        stacks = written_once(stacks)
        moved = stacks.withColumn("_slice", F.col("_slice") + reach).filter(F.col("_slice") < slices)
        stacks, reach = _latest(stacks.unionByName(moved), most), 2 * reach
    starts = stacks.withColumn("_slice", F.col("_slice") + 1).select("_slice", "_key", "_last.*")

    def marked(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        order = ["_at", "id", "_row"]
        own, held = own.sort_values(order), held.sort_values(order)
        return own[["_key", *order]].assign(_new=absent(own["_key"].to_numpy(object), held["_key"].to_numpy(object), most))

    return placed.groupBy("_slice").cogroup(starts.groupBy("_slice")).applyInPandas(marked, "_key string, _at long, id long, _row long, _new boolean")


def _pointers(rows: DataFrame, live: int) -> DataFrame:
    """_row, _next: the first later request of the key that finds the entry too old, if the key isn't evicted before it."""
    rows = rows.withColumn("_bucket", F.expr(f"_at DIV {live}"))
    news = rows.groupBy("_key", "_bucket").agg(F.count_if("_new").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = news.select("_key", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    within = Window.partitionBy("_key", "_bucket").orderBy("_at", "id", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lives = rows.withColumn("_life", F.sum(F.col("_new").cast("long")).over(within)).join(carried, ["_key", "_bucket"]).withColumn("_life", F.col("_life") + F.col("_n"))

    # An entry's end lies in the window after its own: requests there, and the ends that ask for the first one behind them.
    target = F.struct("_row", "_life")
    asked = lives.select("_key", "_bucket", "_at", "id", "_row", "_life", target.alias("_to"), F.lit(0).alias("_end"))
    ends = lives.select("_key", (F.col("_bucket") + 1).alias("_bucket"), (F.col("_at") + live).alias("_at"), "id", "_row", "_life", F.lit(None).cast(asked.schema["_to"].dataType).alias("_to"), F.lit(1).alias("_end"))
    both = asked.unionByName(ends)
    backwards = Window.partitionBy("_key", "_bucket").orderBy(F.desc("_at"), F.desc("_end"), F.desc("id"), F.desc("_row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = both.groupBy("_key", "_bucket").agg(F.min(F.when(F.col("_end") == 0, F.struct("_at", "id", "_row", "_life"))).alias("_f")).withColumn("_f", F.when(F.col("_f").isNotNull(), F.struct("_f._row", "_f._life")))
    later = Window.partitionBy("_key").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    onward = firsts.select("_key", "_bucket", F.last("_f", ignorenulls=True).over(later).alias("_later"))
    found = both.withColumn("_to", F.last("_to", ignorenulls=True).over(backwards)).filter("_end = 1").join(onward, ["_key", "_bucket"]).withColumn("_to", F.coalesce("_to", "_later"))
    return found.filter("_to._life = _life").select("_row", F.col("_to._row").alias("_next"))


def _reached(roots: DataFrame, pointers: DataFrame) -> DataFrame:
    """_row of the roots and of all that pointers lead to from them."""
    reached, pointers = written_once(roots.select("_row")), written_once(pointers)
    while not pointers.isEmpty():
        reached = written_once(reached.unionByName(reached.join(pointers, "_row").select(F.col("_next").alias("_row"))).distinct())
        pointers = written_once(pointers.join(pointers.select(F.col("_row").alias("_next"), F.col("_next").alias("_then")), "_next").select("_row", F.col("_then").alias("_next")))
    return reached


def cache_replay(requests: DataFrame, key: Column, seconds: int = SECONDS, most: int | None = MOST, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """requests (id, ts) with hit: the cache held the key, and no longer than so many seconds.

    ts is a TIMESTAMP or a number of seconds, read to microseconds; requests of one time are
    ordered by id. most: the entries that the cache has room for, None for all.
    Entries that are too old keep their room until they are asked for or evicted.
    A null key is the empty one. A request without ts is no request of the
    replay and is a miss. Repeated rows are requests of their own. No rows: no rows.
    """
    if seconds <= 0 or (most is not None and most <= 0):
        raise ValueError("a cache needs room and a time to live")
    at = F.round(F.col("ts").cast("double") * 1_000_000).cast("long")
    rows = requests.select(F.coalesce(key.cast("string"), F.lit("")).alias("_key"), at.alias("_at"), F.col("id").cast("long").alias("id"))
    timed = written_once(rows.filter("_at IS NOT NULL").withColumn("_row", F.monotonically_increasing_id()))
    if most is None:
        first = timed.groupBy("_key").agg(F.min(F.struct("_at", "id", "_row"))["_row"].alias("_first"))
        marked = timed.join(first.select(F.col("_first").alias("_row"), F.lit(True).alias("_new")), "_row", "left").fillna(False, ["_new"])
    else:
        marked = _evicted(timed, most, rows_per_slice)
    marked = written_once(marked)
    misses = _reached(marked.filter("_new"), _pointers(marked, seconds * 1_000_000))
    hits = marked.join(misses.withColumn("_missed", F.lit(True)), "_row", "left").select("id", F.col("_missed").isNull().alias("hit"))
    return hits.unionByName(rows.filter("_at IS NULL").select("id", F.lit(False).alias("hit")))


def hit_rate(replayed: DataFrame) -> DataFrame:
    return replayed.agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits")).withColumn("rate", F.round(F.col("hits") / F.greatest("requests", F.lit(1)), 4))
