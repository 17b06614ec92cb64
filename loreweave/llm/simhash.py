"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints within ``distance`` bits are linked. The bits are grouped
into partitions so that correlated bits meet in one; partition i gets a threshold
t_i of its own, and if the (t_i + 1) add up to distance + 1, two linked
fingerprints are within t_i bits of each other in some partition i. Thresholds
differ: -1 leaves a partition out. They, and the number of partitions, are chosen
by dynamic programming on the rows and candidates that they would make, estimated
from a bounded sample of fingerprints. The sample sways the cost, never the
result. Candidates meet by an equi-join on a partition's bits, where a threshold
of 1 or 2 also tries the values one bit away (on one side or on both), and are
verified in the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batches, fixed, text_of
from .components import components

BITS = 64
#: Fingerprints in the sample that estimates candidates.
SAMPLE = 3000
#: A candidate's cost, in rows of the join's input.
CANDIDATE_COST = 0.05
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: str, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included; fewer words than width are one shingle, no words none."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is in over half of the hashes; 0 if there are none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, hashes.size, _BLOCK):
        counts += np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > hashes.size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long). Null and empty texts: 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(shingle_hashes(t, width, seed)) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp})

    return by_batches(docs.select("doc_id", text_of().alias("text")), run, "fp long")


class Part(NamedTuple):
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def correlated_groups(sample: np.ndarray, n: int) -> list[tuple[int, ...]]:
    """The bits in n groups of about equal size; a group grows by the bit that correlates most with it."""
    set_bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    set_bits -= set_bits.mean(axis=0) if len(set_bits) else 0
    norms = np.sqrt((set_bits**2).sum(axis=0)) + 1e-9
    likeness = np.abs(set_bits.T @ set_bits) / np.outer(norms, norms)
    left, groups = list(range(BITS)), []
    for lo, hi in pairwise(round(BITS * i / n) for i in range(n + 1)):
        group = [max(left, key=lambda b: (likeness[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < hi - lo:
            group.append(max(left, key=lambda b: (likeness[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


def allocate(sample: np.ndarray, n_all: int, distance: int, most_groups: int = 8) -> list[Part]:
    """Partitions and thresholds of the least estimated cost, by dynamic programming over the partitions."""
    i, j = np.triu_indices(len(sample), 1)
    differing = sample[i] ^ sample[j]
    best: tuple[float, list[Part]] = (float("inf"), [])
    for n in range(max(1, -(-(distance + 1) // 3)), most_groups + 1):
        # at[s]: least cost and thresholds of the groups so far, whose (t + 1) add up to s
        at: dict[int, tuple[float, list[Part]]] = {0: (0.0, [])}
        for bits in correlated_groups(sample, n):
            apart = np.bitwise_count(differing & np.uint64(sum(1 << b for b in bits)))
            grown: dict[int, tuple[float, list[Part]]] = {}
            for t in (-1, 0, 1, 2):
                rows = {-1: 0, 0: 2, 1: 2 + len(bits), 2: 2 * (1 + len(bits))}[t] * n_all
                share = np.count_nonzero(apart <= t) / max(len(apart), 1) if t >= 0 else 0.0
                cost = rows + CANDIDATE_COST * share * n_all * (n_all - 1) / 2
                for s, (so_far, parts) in at.items():
                    to = s + t + 1
                    if to <= distance + 1 and so_far + cost < grown.get(to, (float("inf"),))[0]:
                        grown[to] = (so_far + cost, [*parts, Part(bits, t)])
            at = grown
        if distance + 1 in at and at[distance + 1][0] < best[0]:
            best = at[distance + 1]
    return [p for p in best[1] if p.threshold >= 0]


def _keys(parts: list[Part], probe: bool) -> Column:
    """A fingerprint's values of the join key: its bits in each partition, and one bit away where the threshold asks for it."""
    keys = []
    for k, part in enumerate(parts):
        own = F.col("fp").bitwiseAND(F.lit(signed(part.mask)))
        near = part.bits if part.threshold == 2 or (part.threshold == 1 and probe) else ()
        keys += [F.struct(F.lit(k).alias("part"), v.alias("value")) for v in (own, *(own.bitwiseXOR(F.lit(signed(1 << b))) for b in near))]
    return F.explode(F.array(*keys)).alias("key")


def linked(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs a < b of fingerprints (column fp, each once) that differ in 1 to distance bits, each pair once."""
    n_all = nodes.count()
    sample = np.array([r["fp"] for r in nodes.orderBy(F.xxhash64("fp", F.lit(7))).limit(SAMPLE).select("fp").collect()], np.int64).view(np.uint64)
    parts = allocate(sample, n_all, distance)
    left = nodes.select(F.col("fp").alias("a"), _keys(parts, probe=True))
    right = nodes.select(F.col("fp").alias("b"), _keys(parts, probe=False))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return left.hint("merge").join(right, (left["key"] == right["key"]) & near).select("a", "b").distinct()


def near_copies(docs: DataFrame, distance: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id for every row of docs.

    component_id is the least doc_id that links lead to, the document's own
    included. Equal fingerprints are one node, so copies make no pairs, and a node
    has at most as many links as fingerprints lie within distance.

    Null and empty texts have fingerprint 0, which is linked like any other. A
    null doc_id is no candidate for component_id; a component without any other
    has null. Very long texts are read whole, eight bytes a word in a task. Repeated
    rows are kept. No rows: no rows. Other columns of docs are ignored.
    """
    rows = fixed(fingerprints(docs, width, seed))
    nodes = fixed(rows.groupBy("fp").agg(F.min("doc_id").alias("_first")))
    roots = components(linked(nodes, distance))
    members = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "_first", F.coalesce("root", "fp").alias("root"))
    least = members.groupBy("root").agg(F.min("_first").alias("component_id"))
    return rows.join(members.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def fp_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
