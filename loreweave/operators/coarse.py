"""An approximate index of vectors: lists around centroids, and codes of what is left to them.

For each length of vectors centroids are fitted on a bounded sample. Every vector
goes to the list of its nearest centroid, with its residual in one byte a number.
A query looks into the lists of its nearest centroids, scores their codes, and
compares the best of these anew with the vectors themselves. How many of the true
neighbours that finds is for ``recall`` to say, against the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import BLOCK_BYTES, ranked

#: Vectors of a length that centroids are fitted on, at most; rounds of the fit.
SAMPLE, ROUNDS = 20_000, 8
#: Most lists of a length; they are about the root of the number of vectors.
LISTS = 1024
#: Candidates for each neighbour that are compared anew.
AGAIN = 8


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of unit vectors, themselves of length 1; a list that loses all its vectors begins anew at one of the sample."""
    rng = np.random.default_rng(6)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        empty = np.bincount(nearest, minlength=lists) == 0
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centroids = _unit(sums)
    return centroids


class CoarseIndex:
    """The index below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, vectors: DataFrame) -> CoarseIndex:
        """Index vectors (vec_id, embedding); null and empty ones and those without an id are left out.

        The sample of a length are the SAMPLE vectors of the least hash of their id, so it
        doesn't depend on how the table is stored.
        """
        usable = vectors.filter((F.size("embedding") > 0) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        usable.repartitionByRange("vec_id").write.mode("overwrite").parquet(f"{self.folder}/vectors")
        kept = self.spark.read.parquet(f"{self.folder}/vectors")
        sizes = {r["dim"]: r["n"] for r in kept.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
        centroids = {}
        for dim, n in sizes.items():
            sample = kept.filter(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("embedding").toPandas()["embedding"]
            centroids[dim] = fitted(_unit(np.stack(sample.to_numpy())), max(1, min(LISTS, round(n**0.5), len(sample))))
        rows = [(d, k, c.tolist()) for d, m in centroids.items() for k, c in enumerate(m)]
        self.spark.createDataFrame(rows, "dim int, list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/centroids")
        shared = self.spark.sparkContext.broadcast(centroids)  # LISTS of each length at most

        def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, own in batch.groupby(batch["embedding"].str.len()):
                    m = _unit(np.stack(own["embedding"].to_numpy()))
                    at = np.argmax(m @ shared.value[dim].T, axis=1)
                    left = m - shared.value[dim][at]
                    scale = np.maximum(np.abs(left).max(axis=1), 1e-12) / 127
                    yield pd.DataFrame({"vec_id": own["vec_id"], "dim": dim, "list": at, "scale": scale, "codes": [c.tobytes() for c in np.round(left / scale[:, None]).astype(np.int8)]})

        kind = kept.schema["vec_id"].dataType.simpleString()
        codes = kept.mapInPandas(coded, f"vec_id {kind}, dim int, list int, scale double, codes binary")
        # A list of many vectors is spread over files.
        codes.repartition("dim", "list", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.mode("overwrite").partitionBy("dim", "list").parquet(f"{self.folder}/codes")
        return self

    def _probed(self, queries: DataFrame, dim: int, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
        """query_id, vec_id of the AGAIN * k best codes of each query in a task, for a block of queries."""
        rows = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).collect()  # at most BLOCK_BYTES
        asked, unit = np.array([r["query_id"] for r in rows], object), _unit(np.array([r["query"] for r in rows], np.float64).reshape(-1, dim))
        near = unit @ centroids.T
        lists = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        shared = self.spark.sparkContext.broadcast({int(v): np.flatnonzero((lists == v).any(axis=1)) for v in np.unique(lists)})
        matrix = self.spark.sparkContext.broadcast((unit, near))

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            unit, near = matrix.value
            for batch in batches:
                found = []
                for v, own in batch.groupby("list"):
                    who = shared.value.get(v)
                    codes = np.frombuffer(b"".join(own["codes"]), np.int8).reshape(len(own), dim).astype(np.float32) * own["scale"].to_numpy(np.float32)[:, None]
                    scores = near[who, v][:, None] + unit[who] @ codes.T
                    best = np.argsort(-scores, axis=1, kind="stable")[:, : AGAIN * k]
                    found.append(pd.DataFrame({"query_id": np.repeat(asked[who], best.shape[1]), "vec_id": own["vec_id"].to_numpy()[best].reshape(-1), "score": np.take_along_axis(scores, best, axis=1).reshape(-1)}))
                if found:
                    yield pd.concat(found)

        kinds = [queries.schema["query_id"].dataType.simpleString(), self.spark.read.parquet(f"{self.folder}/vectors").schema["vec_id"].dataType.simpleString()]
        held = self.spark.read.schema(f"vec_id {kinds[1]}, scale double, codes binary, dim int, list int").parquet(f"{self.folder}/codes")
        wanted = held.filter((F.col("dim") == dim) & F.col("list").isin([int(v) for v in np.unique(lists)] or [-1])).select("vec_id", "list", "scale", "codes")
        return wanted.mapInPandas(scored, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")

    def near(self, queries: DataFrame, k: int, probes: int = 16) -> DataFrame:
        """query_id, vec_id, score, rank of about the k nearest vectors of each query (query_id, query), scores as the exact search has them.

        More probes find more of them; all lists together find what the codes tell
        apart. A query of a length that has no vectors finds none.
        """
        centroids: dict[int, list] = {}
        for r in self.spark.read.parquet(f"{self.folder}/centroids").orderBy("dim", "list").collect():
            centroids.setdefault(r["dim"], []).append(r["centroid"])
        sizes = queries.groupBy(F.size("query").alias("dim")).agg(F.count(F.lit(1)).alias("n")).filter("dim > 0").collect()
        parts = []
        for dim, n in sizes:
            if dim in centroids:
                blocks = max(1, -(-n * 8 * dim // BLOCK_BYTES))
                own = queries.filter(F.size("query") == dim)
                of = [own.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [own]
                parts += [self._probed(q, dim, np.array(centroids[dim]), k, probes) for q in of]
        kept = self.spark.read.parquet(f"{self.folder}/vectors")
        if not parts:
            return queries.join(kept.limit(0), F.lit(False)).select("query_id", "vec_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
        candidates = ranked(reduce(DataFrame.unionByName, parts), ["query_id"], "score", "vec_id", AGAIN * k).select("query_id", "vec_id")

        def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for _, own in b.groupby(b["query"].str.len()):
                    q, v = (_unit(np.stack(own[c].to_numpy())) for c in ("query", "embedding"))
                    yield pd.DataFrame({"query_id": own["query_id"], "vec_id": own["vec_id"], "score": np.maximum(np.round((q * v).sum(axis=1), 6), 0.0)})

        both = candidates.join(kept, "vec_id").join(queries.select("query_id", F.col("query").cast("array<double>").alias("query")), "query_id")
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {kept.schema['vec_id'].dataType.simpleString()}, score double"
        return ranked(both.select("query_id", "vec_id", "query", "embedding").mapInPandas(exact, schema), ["query_id"], "score", "vec_id", k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n, n_found, recall: how many of the exact neighbours (query_id, vec_id) were found."""
    hits = exact.join(found.select("query_id", "vec_id").distinct().withColumn("_f", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n"), F.count("_f").alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.greatest("n", F.lit(1)), 4))


