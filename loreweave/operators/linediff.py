"""Line by line differences of two texts, aligned by anchors.

Lines that occur once on each side of a stretch are anchors; of those a longest run
that rises on both sides is matched, and so are equal lines at a stretch's start and
end. Matches cut the texts into shorter stretches, in which other lines are alone;
rounds go on until none finds a match. What isn't matched was removed or added.
What both texts begin and end with is told inside the row, so only lines between are
rows, which are aligned for all texts at once.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.sources.checkpoints import written_once

CONTEXT = 3


def rising(second: list[int]) -> list[int]:
    """The places of a longest rising run."""
    ends: list[int] = []  # by length, the place of the least last value
    values: list[int] = []
    before: list[int] = []
    for k, v in enumerate(second):
        at = bisect_left(values, v)
        before.append(ends[at - 1] if at else -1)
        values[at : at + 1], ends[at : at + 1] = [v], [k]
    run, k = [], ends[-1] if ends else -1
    while k >= 0:
        run.append(k)
        k = before[k]
    return run[::-1]


def _leading(a: Column, b: Column) -> Column:
    """How many lines two arrays begin with alike."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)).cast("int")
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1)


def _chained(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("old")
    return group.iloc[rising(group["new"].tolist())][["_key", "old", "new"]]


def _stretches(lines: DataFrame) -> DataFrame:
    """lines (_key, side, n, hash, to) that aren't matched, with the number of matches before them."""
    order = Window.partitionBy("_key", "side").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("seg", F.count("to").over(order)).filter(F.col("to").isNull())


def _ends(free: DataFrame, last: bool) -> DataFrame:
    """Matches (_key, old, new) of the equal lines that stretches begin with, or end with."""
    order = F.desc("n") if last else F.asc("n")
    placed = free.withColumn("_r", F.row_number().over(Window.partitionBy("_key", "side", "seg").orderBy(order)))
    old = placed.filter("side = 0").select("_key", "seg", "_r", F.col("n").alias("old"), "hash")
    new = placed.filter("side = 1").select("_key", "seg", "_r", F.col("n").alias("new"), F.col("hash").alias("_other"))
    met = old.join(new, ["_key", "seg", "_r"])
    so_far = Window.partitionBy("_key", "seg").orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return met.withColumn("_same", F.min((F.col("hash") == F.col("_other")).cast("int")).over(so_far)).filter("_same = 1").select("_key", "old", "new")


def _anchors(free: DataFrame) -> DataFrame:
    """Matches of lines that are alone on both sides of their stretch, a longest rising run of them."""
    alone = free.groupBy("_key", "seg", "hash").agg(F.count_if(F.col("side") == 0).alias("_a"), F.count_if(F.col("side") == 1).alias("_b"), F.max(F.when(F.col("side") == 0, F.col("n"))).alias("old"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("new"))
    kind = free.schema["_key"].dataType.simpleString()
    return alone.filter("_a = 1 AND _b = 1").groupBy("_key", "seg").applyInPandas(_chained, f"_key {kind}, old int, new int")


def _matched(lines: DataFrame, found: DataFrame) -> DataFrame:
    both = found.select("_key", F.lit(0).alias("side"), F.col("old").alias("n"), F.col("new").alias("_to")).unionByName(found.select("_key", F.lit(1).alias("side"), F.col("new").alias("n"), F.col("old").alias("_to")))
    return lines.join(both, ["_key", "side", "n"], "left").withColumn("to", F.coalesce("to", "_to")).drop("_to")


def line_changes(pairs: DataFrame, key: str) -> DataFrame:
    """key, place, op, old_no, new_no, line: the lines of two texts in one order.

    pairs: key, which tells each pair and isn't null, old and new. op is ' ' for
    a line of both, '-' for one that was removed, '+' for one that was added; of a
    stretch the removed ones come first. Lines are what stands between line feeds, so a text
    always has one; a null text is an empty one. Lines are equal by their SHA-256.
    No rows: no rows.
    """
    size, lines_of = F.size, lambda c: F.split(F.coalesce(F.col(c), F.lit("")), "\n", -1)
    both = pairs.select(F.col(key).alias("_key"), lines_of("old").alias("_o"), lines_of("new").alias("_w")).withColumn("_p", _leading(F.col("_o"), F.col("_w")))
    after = lambda c: F.reverse(F.slice(c, F.col("_p") + 1, size(c)))
    both = both.withColumn("_q", _leading(after("_o"), after("_w"))).withColumns({"_mo": size("_o") - F.col("_p") - F.col("_q"), "_mw": size("_w") - F.col("_p") - F.col("_q")})
    middle = lambda c, n: F.slice(c, F.col("_p") + 1, F.col(n))
    sides = both.filter("_mo > 0 AND _mw > 0").select("_key", "_p", F.posexplode(F.array(middle("_o", "_mo"), middle("_w", "_mw"))).alias("side", "_l"))
    texts = written_once(sides.select("_key", "side", "_p", F.posexplode("_l").alias("n", "line")).withColumn("n", F.col("n") + F.col("_p")))
    lines = written_once(texts.select("_key", "side", "n", F.unhex(F.sha2("line", 256)).alias("hash"), F.lit(None).cast("int").alias("to")))
    while True:
        more = 0
        for find in (lambda f: _ends(f, False), lambda f: _ends(f, True), _anchors):
            found = written_once(find(_stretches(lines)))
            n = found.count()
            if n:
                lines, more = written_once(_matched(lines, found)), more + n
        if not more:
            break
    order = Window.partitionBy("_key", "side").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("_seg", F.count("to").over(order)).drop("hash").join(texts, ["_key", "side", "n"])
    rows = placed.filter("side = 0 OR to IS NULL").select(
        "_key",
        F.when(F.col("to").isNotNull(), " ").when(F.col("side") == 0, "-").otherwise("+").alias("op"),
        F.when(F.col("side") == 0, F.col("n") + 1).alias("old_no"),
        F.when(F.col("side") == 1, F.col("n") + 1).otherwise(F.col("to") + 1).alias("new_no"),
        "line",
        "_p",
        "_seg",
        F.when(F.col("to").isNotNull(), 2).otherwise(F.col("side")).alias("_ord"),
        "n",
    )
    place = (F.col("_p") + F.row_number().over(Window.partitionBy("_key").orderBy("_seg", "_ord", "n"))).alias("place")
    columns = ("place", "op", "old_no", "new_no", "line")
    within = rows.select("_key", place, *columns[1:])
    met = written_once(lines.filter("side = 0 AND to IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).cast("int").alias("_m")))
    outer = both.join(met, "_key", "left").withColumn("_c", F.col("_mo") + F.col("_mw") - F.coalesce("_m", F.lit(0)))
    none = F.lit(None).cast("int")

    def told(lines: Column, first: Column, op: str, old: Column, new: Column) -> Column:
        """lines with their places, from those of the first one on."""
        return F.transform(lines, lambda x, i: F.struct((first + i).alias("place"), F.lit(op).alias("op"), (old + i).alias("old_no"), (new + i).alias("new_no"), x.alias("line")))

    p, q, after_middle = F.col("_p"), F.col("_q"), F.col("_p") + F.col("_c") + 1
    alone = F.concat(told(middle("_o", "_mo"), p + 1, "-", p + 1, none), told(middle("_w", "_mw"), p + F.col("_mo") + 1, "+", none, p + 1))
    ends = told(F.slice("_o", size("_o") - q + 1, q), after_middle, " ", size("_o") - q + 1, size("_w") - q + 1)
    begins = told(F.slice("_o", F.lit(1), p), F.lit(1), " ", F.lit(1), F.lit(1))
    kept = F.concat(begins, F.when((F.col("_mo") == 0) | (F.col("_mw") == 0), alone).otherwise(F.slice(alone, 1, 0)), ends)
    return outer.select("_key", F.inline(kept)).select("_key", *columns).unionByName(within).withColumnRenamed("_key", key)


def change_counts(changes: DataFrame, key: str) -> DataFrame:
    """key, added, removed."""
    return changes.groupBy(key).agg(F.count_if(F.col("op") == "+").cast("int").alias("added"), F.count_if(F.col("op") == "-").cast("int").alias("removed"))


def _range(first: Column, n: Column) -> Column:
    """Where a part of a diff stands: its first line and, but for one, how many; of none, the line before."""
    return F.when(n == 1, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit(","), n.cast("string")))


def unified(changes: DataFrame, key: str, context: int = CONTEXT) -> DataFrame:
    """key, diff: the changes with so many lines around them, in hunks; '' where nothing changed."""
    own = Window.partitionBy(key).orderBy("place")
    changed = (F.col("op") != " ").cast("int")
    near = F.max(changed).over(own.rowsBetween(-context, context)) == 1
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    counted = changes.withColumns({"_old": F.count("old_no").over(before), "_new": F.coalesce(F.count_if(F.col("op") != "-").over(before), F.lit(0)), "_near": near})
    kept = counted.filter("_near").withColumn("_gap", F.coalesce(F.col("place") - F.lag("place").over(own) > 1, F.lit(True)).cast("int")).withColumn("_hunk", F.sum("_gap").over(own))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("op", "line").alias("l")))), lambda x: x["l"]), "\n")
    hunks = kept.groupBy(key, "_hunk").agg(F.min("_old").alias("_o"), F.min("_new").alias("_w"), F.count_if(F.col("op") != "+").alias("_on"), F.count_if(F.col("op") != "-").alias("_wn"), lines.alias("_l"))
    first = lambda start, n: start + F.when(n == 0, 0).otherwise(1)
    head = F.concat(F.lit("@@ -"), _range(first(F.col("_o"), F.col("_on")), F.col("_on")), F.lit(" +"), _range(first(F.col("_w"), F.col("_wn")), F.col("_wn")), F.lit(" @@\n"), F.col("_l"))
    parts = hunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_hunk", head.alias("h")))), lambda x: x["h"]), "\n").alias("_d"))
    return changes.select(key).distinct().join(parts, key, "left").select(key, F.coalesce(F.concat(F.lit("--- old\n+++ new\n"), "_d"), F.lit("")).alias("diff"))
