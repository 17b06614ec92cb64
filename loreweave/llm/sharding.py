"""Rendezvous hashing of record keys over weighted shards.

Every (key, shard) pair has a uniform number u; a record goes to the shard with
the least -ln(u) / weight. A pair's number depends on nothing else, so a new
shard takes rows only into itself and the other records stay where they are.
Eight hexadecimal digits of md5(key:block) serve as u, four shards to a digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fixed, gapless_rank, parts_for, text_of

#: Values of one draw of eight hexadecimal digits.
DRAWS = 2.0**32


def draw(key: Column, shard: int) -> Column:
    """The pair's number in 0 .. 2**32 - 1."""
    digest = F.md5(F.concat(key, F.lit(f":{shard // 4}")))
    return F.conv(F.substring(digest, 8 * (shard % 4) + 1, 8), 16, 10).cast("long")


def cost(key: Column, shard: int, weight: float) -> Column:
    return -F.log((draw(key, shard) + 0.5) / DRAWS) / weight


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of the least cost; of equal ones, the first. A null key hashes as ''."""
    if not weights or min(weights) <= 0:
        raise ValueError("shard weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit(""))
    return F.array_min(F.array(*(F.struct(cost(key, s, w).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights))))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], extra_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard for every row of docs.

    size: UTF-8 bytes of the text plus 1. slot numbers the rows of a shard from
    0. grown_shard: the shard with one more shard of extra_weight.

    The shard follows from doc_id and the weights alone. Null text: no bytes and
    the checksum of the empty text. Null doc_id: as the empty key. Repeated rows
    each get a slot of their own. Texts of any length are measured whole. No rows:
    no rows. Other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32"))
    last = len(weights)
    kept = sized.withColumn("shard", shard_of(F.col("doc_id"), weights))
    # One more draw decides: the new shard takes the row or it stays.
    own = F.array(*(cost(key, s, w) for s, w in enumerate(weights)))
    kept = kept.withColumn("grown_shard", F.when(cost(key, last, extra_weight) < F.get(own, F.col("shard")), F.lit(last)).otherwise(F.col("shard")))
    kept = fixed(kept)
    parts = parts_for(kept.count(), last)
    row = F.concat_ws(":", key, F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    part = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long") % parts
    return gapless_rank(kept.withColumn("_part", part), ["shard"], "_part", ["doc_id", "size", "text_crc32"], "slot").drop("_part")
