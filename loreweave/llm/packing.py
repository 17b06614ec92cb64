"""Best-fit packing of token pieces after a dominance reduction.

Pieces of equal length are interchangeable, so an instance is a histogram of at
most ``capacity`` lengths, however many rows there are. Spark counts it and the
driver plans on it: the reduction of Martello and Toth fixes sets of pieces that
provably dominate every other set with the same piece, then best fit decreasing
packs what is left. The plan says, for a range of ranks of a length, which
sequences take them; the rows are ranked within their length and look it up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import by_batches, fixed, gapless_rank, text_of

#: Ends every document.
END_ID = 1
#: Plan rows that are sent to every executor; a larger plan is shuffled by length.
MOST_BROADCAST = 200_000


class Fill(NamedTuple):
    """``bins`` sequences that each hold, in this order, ``n`` pieces of each (length, n)."""

    bins: int
    items: tuple[tuple[int, int], ...]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[Fill]:
    """Take what can be fixed out of counts.

    A set with piece j dominates another one with j if the other's companions
    can be put into its own. Fixed are: a piece that nothing fits with; j and k
    that fill a sequence exactly, or where k is the largest that fits and no two
    smaller pieces fit beside j, or no two of them, if three can't, make up more than k.
    """
    done: list[Fill] = []

    def fix(n: int, *items: tuple[int, int]) -> None:
        done.append(Fill(n, items))
        for length, each in items:
            counts[length] -= n * each
            if not counts[length]:
                del counts[length]

    if counts.get(capacity):
        fix(counts[capacity], (capacity, 1))
    for j in sorted(counts, reverse=True):
        k = capacity - j
        if j > k and k in counts:
            fix(min(counts[j], counts[k]), (j, 1), (k, 1))
        elif j == k and counts[j] > 1:
            fix(counts[j] // 2, (j, 2))
    changed = True
    while changed and counts:
        changed = False
        sizes = sorted(counts)
        for j in reversed(sizes[:]):
            while counts.get(j):
                room = capacity - j
                others = sizes[:]
                if counts[j] == 1:
                    others.remove(j)
                fitting = bisect_right(others, room)
                if not fitting:
                    fix(counts[j] if j not in others or 2 * j > capacity else 1, (j, 1))
                else:
                    small = [x for s in others[:3] for x in [s] * min(3, counts[s] - (s == j))][:3]
                    k = others[fitting - 1]
                    if len(small) > 2 and sum(small) <= room or _best_pair(others[:fitting], counts, j, room) > k:
                        break
                    fix(counts[j] // 2, (j, 2)) if k == j else fix(min(counts[j], counts[k]), (j, 1), (k, 1))
                changed = True
                sizes = [s for s in sizes if s in counts]
    return done


def _best_pair(sizes: list[int], counts: dict[int, int], j: int, room: int) -> int:
    """The largest sum of two pieces, besides one j, within room; 0 if there is none."""
    best, low, high = 0, 0, len(sizes) - 1
    while low <= high:
        total = sizes[low] + sizes[high]
        twice = low != high or counts[sizes[low]] - (sizes[low] == j) > 1
        if total <= room and twice:
            best = max(best, total)
        if total <= room:
            low += 1
        else:
            high -= 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Fill]:
    """Best fit decreasing, for all pieces of a length and all sequences alike at once."""
    free: dict[int, list[Fill]] = {}
    rooms: list[int] = []

    def put(room: int, fill: Fill) -> None:
        if room not in free:
            free[room] = []
            insort(rooms, room)
        free[room].append(fill)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, fill = capacity, Fill(left, ())
            else:
                room = rooms[at]
                fill = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            each = room // length
            full = min(fill.bins, left // each)
            if full:
                put(room - each * length, Fill(full, (*fill.items, (length, each))))
                left -= full * each
            rest = fill.bins - full
            if rest and left:
                put(room - min(left, each) * length, Fill(1, (*fill.items, (length, min(left, each)))))
                left -= min(left, each)
                rest -= 1
            if rest and fill.items:
                put(room, Fill(rest, fill.items))
    return [f for fills in free.values() for f in fills]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces in a sequence, first sequence, offset)."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"piece lengths must be 1 to {capacity}")
    rows, next_rank, sequence = [], dict.fromkeys(counts, 0), 0
    for bins, items in [*reduce_by_dominance(counts, capacity), *best_fit(counts, capacity)]:
        offset = 0
        for length, n in items:
            first = next_rank[length]
            next_rank[length] = first + bins * n
            rows.append((length, first, first + bins * n, n, sequence, offset))
            offset += n * length
        sequence += bins
    return rows


def cut_documents(docs: DataFrame, path: str, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces of the tokenized documents: doc_id, piece, start, length, ids_crc32, with ids if asked for.

    A document is its ids and END_ID; only longer ones than capacity are cut, into
    pieces of capacity, however long they are. Null and empty texts are END_ID
    alone. Repeated rows are cut alike, a null doc_id stays null. No rows: no rows.
    Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([END_ID], "<u4")
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encoder(path).encode(batch["text"].tolist()), strict=True):
                ids = np.concatenate([ids, end])
                for piece, start in enumerate(range(0, ids.size, capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, part.size, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return by_batches(docs.select("doc_id", text_of().alias("text")), run, "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (doc_id, piece, length and others) with sequence_id and offset.

    A sequence holds at most capacity tokens and its pieces follow on each other
    from offset 0. Pieces of equal length are ranked by doc_id and piece; equal
    rows each get a place. Lengths outside 1 to capacity, and null ones, raise
    an error. No rows: no rows. Columns named sequence_id or offset are replaced,
    those of the names that are used on the way dropped, others stay.
    """
    pieces = fixed(pieces.drop("sequence_id", "offset", "_rank", "_part", "_at", "_start", "_n", "_first", "_after", "_each", "_sequence", "_offset"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    if None in counts:
        raise ValueError("piece lengths must not be null")
    rows = plan(counts, capacity)
    runs = pieces.sparkSession.createDataFrame(rows, "length long, _first long, _after long, _each long, _sequence long, _offset long")
    parts = max(8, sum(counts.values()) // 200_000)
    ranked = gapless_rank(pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts))), ["length"], "_part", ["doc_id", "piece"], "_rank").drop("_part")
    placed = ranked.join(F.broadcast(runs) if len(rows) <= MOST_BROADCAST else runs, (ranked["length"] == runs["length"]) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_after"))).drop(runs["length"])
    nth = F.col("_rank") - F.col("_first")
    placed = placed.withColumn("sequence_id", F.col("_sequence") + F.floor(nth / F.col("_each")).cast("long"))
    placed = placed.withColumn("offset", F.col("_offset") + (nth % F.col("_each")) * F.col("length"))
    return placed.drop("_rank", "_first", "_after", "_each", "_sequence", "_offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. ``packed`` has ids.

    Pieces follow on each other by offset; a null array of ids counts as none. A
    sequence is one value of at most capacity ids. No rows: no rows. Other columns
    are ignored.
    """
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return parts.select("sequence_id", F.flatten(F.transform("_p", lambda p: F.coalesce(p["ids"], F.array().cast("array<int>")))).alias("ids"))
